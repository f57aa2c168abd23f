"""Boosted trees of Spark fitted to cells of binned rows against fits to the rows themselves."""
import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from ostinato.operators import models
from ostinato.operators.trees import feature_rows

COLUMNS = ["a", "b", "c"]


def table(spark, n, seed=0):
    """A continuous feature, one of 50 values, and one in which a value has the shares of many bins."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 50, n), np.where(rng.random(n) < .4, 0.0, np.round(rng.gamma(1, 1, n), 2))])
    y = np.clip(np.round(5 + x[:, 0] + x[:, 1] / 20 + x[:, 2] * rng.normal(size=n)), 0, 10)
    return spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(n)], "id long, grade int, a double, b double, c double")


def scores(model, df):
    return np.array([r["score"] for r in models.score(model, df, COLUMNS).orderBy("id").collect()])


def plain(df, depth, rounds, min_rows):
    return Pipeline(stages=[VectorAssembler(inputCols=COLUMNS, outputCol="features"), GBTRegressor(
        labelCol="grade", predictionCol="score", maxDepth=depth, maxIter=rounds, stepSize=.3, minInstancesPerNode=min_rows, seed=42)]).fit(df)


@pytest.mark.parametrize("n, min_rows, limit", [(2000, 20, 10_000), (60, 20, 25), (39, 20, 10_000)])
def test_trees_of_cells_are_those_of_the_rows(spark, small_tasks, n, min_rows, limit):
    train, others = table(spark, n, n).coalesce(2), table(spark, 500, 7)
    with small_tasks(limit):
        got = models.gbt_pipeline(train, COLUMNS, 4, rounds=5, rate=.3, min_rows=min_rows)
    want = plain(train, 4, 5, min_rows)
    assert [t.numNodes for t in got.stages[-1].trees] == [t.numNodes for t in want.stages[-1].trees]
    for df in (train, others):
        assert np.allclose(scores(got, df), scores(want, df), atol=1e-9)
    assert models.score(got, others, COLUMNS).columns == [*others.columns, "score"]


def test_rounds_do_not_grow_with_copies_of_the_rows(spark, monkeypatch):
    seen, real = [], GBTRegressor._fit
    monkeypatch.setattr(GBTRegressor, "_fit", lambda self, df: seen.append(df.count()) or real(self, df))
    df = table(spark, 300)
    once = models.gbt_pipeline(df, COLUMNS, 3, rounds=2, min_rows=5)
    many = models.gbt_pipeline(df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20)))), COLUMNS, 3, rounds=2, min_rows=100)
    assert seen[0] == seen[1] <= 300 and np.allclose(scores(once, df), scores(many, df))


def test_bins_of_a_long_table_come_from_all_rows(spark):
    """Spark itself draws some 10,000 rows for its bins, others for other partitions."""
    df = table(spark, 15_000)
    one, two = (models.gbt_pipeline(part, COLUMNS, 3, rounds=2) for part in (df.coalesce(1), df.repartition(7)))
    assert one.stages[0].getSplitsArray() == two.stages[0].getSplitsArray()
    assert np.allclose(scores(one, df), scores(two, df))
    n, bounds = models.even_bins(feature_rows(df, COLUMNS), 3)
    a = np.array([r["a"] for r in df.collect()])
    assert n == 15_000 and [len(b) for b in bounds] == [31, 31, 31]
    assert set(np.bincount(np.searchsorted(bounds[0], a))) == {468, 469}
    at_bound = df.filter("id = 5").withColumn("a", F.lit(bounds[0][10]))       # a bound itself lies left of it, as in Spark's trees
    assert one.stages[0].transform(at_bound).first()["_bin0"] == 10


def test_constant_features_and_refusals(spark):
    df = table(spark, 100)
    flat = models.gbt_pipeline(df.withColumn("a", F.lit(0.0)), COLUMNS, 2, rounds=2, min_rows=5)
    assert np.allclose(scores(flat, df), scores(flat, df.withColumn("a", F.lit(9.0))))
    still = models.gbt_pipeline(df.withColumns({c: F.lit(3.0) for c in COLUMNS}).withColumn("grade", F.lit(4)), COLUMNS, 2, rounds=2)
    assert set(scores(still, df)) == {4.0}
    for bad in (df.withColumn("b", F.when(F.col("id") != 3, F.col("b"))), df.withColumn("b", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("b"))),
                df.withColumn("grade", F.when(F.col("id") != 3, F.col("grade")))):
        with pytest.raises(Exception, match="finite"):
            models.gbt_pipeline(bad, COLUMNS, 2, rounds=1)
    with pytest.raises(ValueError, match="rows"):
        models.gbt_pipeline(df.filter("false"), COLUMNS, 2, rounds=1)
    cells = models.feature_cells(df, COLUMNS)
    with pytest.raises(ValueError, match="names"):
        models.gbt_pipeline(cells, ["b", "a", "c"], 2, rounds=1)
    cells.unpersist()
