import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from ostinato.operators import models
from ostinato.plans import queries


def table(spark, n=120, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, .2] + [3, 0, 7]
    y = np.clip(np.round(5 + x[:, 0] - 3 + .3 * x[:, 1] + rng.normal(size=n) * .3), 0, 10)
    parts = ["train"] * (n // 2) + ["val"] * (n // 4) + ["test"] * (n - n // 2 - n // 4)
    return spark.createDataFrame([(f"p{i:03d}", int(y[i]), parts[i], *map(float, x[i])) for i in range(n)],
                                 "id string, grade int, part string, a double, b double, c double"), x, y


COLUMNS = ["a", "b", "c"]


def test_ridge_is_the_closed_form(spark):
    df, x, y = table(spark)
    train = df.filter("part = 'train'")
    model = models.fit_ridge(train.repartition(7), COLUMNS, [10.0])[10.0]
    got = [r["score"] for r in models.score(model, df, COLUMNS).orderBy("id").collect()]
    xt, yt = x[:60], y[:60]
    mean, std = xt.mean(axis=0), xt.std(axis=0)
    z = (xt - mean) / std
    w = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (yt - yt.mean()))
    assert np.allclose(got, (x - mean) / std @ w + yt.mean(), atol=1e-10)
    one = models.ridge_closed_form(train, "a", "grade", [10.0]).first()
    z1 = z[:, 0]
    w1 = z1 @ (yt - yt.mean()) / (z1 @ z1 + 10)
    assert one["slope"] == pytest.approx(w1 / std[0]) and one["intercept"] == pytest.approx(yt.mean() - w1 / std[0] * mean[0])


def test_selection_scores_and_saved_model(spark, tmp_path):
    df, _, _ = table(spark)
    model, trials, predictions = models.select_model(df, COLUMNS, [0.1, 1e4], models.fit_ridge)
    assert trials.count() == 2 and predictions.count() == 30
    models.save_ridge(spark, model, str(tmp_path / "m"))
    again = models.score(models.load_ridge(spark.newSession(), str(tmp_path / "m")), df.filter("part = 'val'"), COLUMNS)
    assert rows(again.select("id", "score"), "id") == rows(predictions.select("id", "score"), "id")
    with pytest.raises(Exception, match="(?i)exists"):
        models.save_ridge(spark, model, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="names"):
        models.score(model, df, ["a", "b"])


@pytest.mark.parametrize("parts", [1, 9])
def test_co_moments(spark, parts):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) * [1, 1e-3, 50, 1] + [1e6, 0, 3, -7]
    df = spark.createDataFrame([(row.tolist(),) for row in x], "_x array<double>").repartition(parts)
    n, mean, products = models.co_moments(df, 4)
    centred = x - x.mean(axis=0)
    assert n == 300 and np.allclose(mean, x.mean(axis=0), rtol=1e-13) and np.allclose(products, centred.T @ centred, rtol=1e-9, atol=1e-9)
    with pytest.raises(ValueError, match="rows"):
        models.co_moments(df.filter("false"), 4)


def test_ridge_with_a_constant_and_a_repeated_column(spark):
    df, _, _ = table(spark)
    more = df.withColumns({"one": F.lit(2.0), "again": F.col("a")})
    model = models.fit_ridge(more, [*COLUMNS, "one", "again"], [1.0])[1.0]
    assert abs(model.weights[3]) < 1e-12 and model.weights[0] == pytest.approx(model.weights[4])
    with pytest.raises(Exception, match="finite"):
        models.fit_ridge(df.withColumn("a", F.lit(float("inf"))), COLUMNS, [1.0])


def test_feature_arrays(spark):
    truth = spark.createDataFrame([("a", 1), ("b", 2)], "id string, grade int")
    one = spark.createDataFrame([("b", 2, [5.0, 6.0]), ("a", 1, [4.0, 3.0]), ("z", 9, [0.0, 0.0])], "id string, grade int, features array<double>")
    two = spark.createDataFrame([("a", 1, [7.0]), ("b", 2, [8.0])], "id string, grade int, features array<double>")
    got, names = models.stack_features(truth, [(one, ["x", "y"]), (two, ["z"])])
    assert rows(got, "id") == [("a", 1, [4.0, 3.0, 7.0]), ("b", 2, [5.0, 6.0, 8.0])] and names == ["x", "y", "z"]
    for bad, what in ((two.filter("id = 'a'"), "missing in feature table 1: b"), (two.unionByName(two), "repeated in feature table 1"),
                      (two.withColumn("grade", F.lit(2)), "label differs in feature table 1: a"), (two.withColumn("grade", F.lit(None).cast("int")), "label differs"),
                      (two.withColumn("features", F.array(F.lit(float("nan")))), "no usable value"), (two.withColumn("features", F.expr("array(1D, 2D)")), "no usable value")):
        with pytest.raises(Exception, match=what):
            models.stack_features(truth, [(one, ["x", "y"]), (bad, ["z"])])[0].collect()
    with pytest.raises(ValueError, match="repeat"):
        models.stack_features(truth, [(one, ["x", "y"]), (two, ["x"])])
    size = lambda width: models.stack_features(truth, [(one, [str(i) for i in range(width)])])[0]._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(2) == size(1000)


def test_assemble(spark):
    truth = spark.createDataFrame([("a", 1), ("b", 2)], "id string, grade int")
    one = spark.createDataFrame([("b", 2, 5.0), ("a", 1, 4.0), ("z", 9, 0.0)], "id string, grade int, x double")
    two = spark.createDataFrame([("a", 1, 7.0), ("b", 2, 8.0)], "id string, grade int, y double")
    assert rows(models.assemble_features(truth, [one, two]), "id") == [("a", 1, 4.0, 7.0), ("b", 2, 5.0, 8.0)]
    with pytest.raises(Exception, match="missing in feature table 1: b"):
        models.assemble_features(truth, [one, two.filter("id = 'a'")]).collect()
    with pytest.raises(Exception, match="label differs in feature table 0: a"):
        models.assemble_features(truth, [one.withColumn("grade", F.lit(2)), two]).collect()
    assert rows(models.missing_features(truth, two.filter("id = 'a'"))) == [("b", "missing")]
    bad = spark.createDataFrame([("a", 1, float("nan")), ("b", 2, 1.0), ("b", 2, 1.0)], "id string, grade int, x double")
    assert rows(models.check_features(bad, ["x"]), "id") == [("a", "not_finite"), ("b", "duplicate_id")]
    text = spark.createDataFrame([("a", 1, "src", 1.0), ("b", 2, None, 1.0)], "id string, grade int, s string, x double")
    assert rows(models.check_features(text, ["s", "x"])) == [("b", "not_finite")]
    assert rows(models.assemble_features(truth, [text.na.fill("none")]), "id") == [("a", 1, "src", 1.0), ("b", 2, "none", 1.0)]
    for spoiled in (text, text.withColumns({"s": F.lit("s"), "x": F.lit(float("inf"))})):
        with pytest.raises(Exception, match="no usable value in feature table 0"):
            models.assemble_features(truth, [spoiled]).collect()


@pytest.mark.parametrize("limit", [40, 10_000])
def test_batches(spark, small_tasks, limit):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 6, 333)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "id long, length long").repartition(5)
    with small_tasks(limit):
        plain = rows(models.length_batches(df, 4), "slot")
        mixed = rows(models.length_batches(df, 4, shuffle=True, epoch=1), "slot")
        again = rows(models.length_batches(df, 4, shuffle=True, epoch=1), "slot")
        other = rows(models.length_batches(df, 4, shuffle=True, epoch=2), "slot")
    assert [r[0] for r in plain] == [i for _, i in sorted((n, i) for i, n in enumerate(lengths))]
    for got in (plain, mixed):
        assert [r[3] for r in got] == list(range(333)) and [r[4] for r in got] == [i // 4 for i in range(333)]
    assert mixed == again and mixed != other and sorted(r[0] for r in mixed) == list(range(333))
    bucket = {r[0]: r[2] for r in plain}
    runs = [bucket[r[0]] for r in mixed]
    assert sum(a != b for a, b in zip(runs, runs[1:])) == max(runs)


def test_padding(spark, small_tasks):
    fr = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("b", 0, [5.0, 6.0]), ("c", 0, [7.0, 8.0])],
                               "id string, frame long, values array<double>")
    batches = spark.createDataFrame([("a", 2, 0), ("b", 1, 0), ("c", 1, 1)], "id string, length long, batch long")
    with small_tasks(1):
        got = rows(models.pad_batches(fr, batches).select("batch", "id", "frame", "values", "real"), "batch", "id", "frame")
    assert got == [(0, "a", 0, [1.0, 2.0], True), (0, "a", 1, [3.0, 4.0], True), (0, "b", 0, [5.0, 6.0], True),
                   (0, "b", 1, [0.0, 0.0], False), (1, "c", 0, [7.0, 8.0], True)]
    with pytest.raises(ValueError, match="channels"):
        models.pad_batches(fr.withColumn("values", F.expr("case when id = 'b' then array(1D) else values end")), batches)


def test_boosted_trees_rank_well(spark):
    df, _, _ = table(spark, 200)
    fit = models.one_by_one(lambda t, c, depth: models.gbt_pipeline(t, c, int(depth), rounds=30, min_rows=5, rate=.2))
    best, trials, predictions = models.select_model(df, COLUMNS, [2, 3], fit)
    assert trials.agg(F.max("kendall_tau_c")).first()[0] > 0.6 and "score" in predictions.columns
    with pytest.raises(ValueError, match="names"):
        models.score(best, df, ["b", "a", "c"])


def test_boosting_query_runs_the_whole_grid(spark, monkeypatch):
    asked, fit = [], models.gbt_pipeline

    def few_rounds(train, columns, depth, label="grade", rounds=300, **more):
        asked.append((depth, rounds))
        return fit(train, columns, depth, label, 2, **more)
    monkeypatch.setattr(models, "gbt_pipeline", few_rounds)
    assert queries.QUERIES["gbt_predictions"](spark, "/root/testdata/sf0.001").count() > 0
    assert sorted(asked) == [(depth, 300) for depth in (3, 4, 5, 6, 7)]
