"""Boosted trees against a plain best-first fit in numpy, one split at a time."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from ostinato.operators import models, trees


def data(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 12, n), rng.normal(size=n) * 50])
    y = np.clip(np.round(5 + 2 * np.sin(3 * x[:, 0]) + (x[:, 1] > 6) * x[:, 2] / 40 + rng.normal(size=n) * .3), 0, 10)
    return x, y


def table(spark, x, y, parts=None):
    parts = parts or ["train"] * len(y)
    return spark.createDataFrame([(i, int(y[i]), parts[i], *map(float, x[i])) for i in range(len(y))], "id long, grade int, part string, a double, b double, c double")


def plain_fit(x, y, leaves, rounds, rate, l2, min_rows):
    """Best-first trees over all midpoints of neighbouring values; predictions of the rows after all rounds."""
    score = np.full(len(y), y.mean())
    for _ in range(rounds):
        g = score - y

        def best(index):
            found = (0.0, None, None)
            total = g[index].sum() ** 2 / (len(index) + l2)
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    left = index[x[index, f] <= cut]
                    right = index[x[index, f] > cut]
                    if min(len(left), len(right)) >= min_rows:
                        gain = g[left].sum() ** 2 / (len(left) + l2) + g[right].sum() ** 2 / (len(right) + l2) - total
                        if gain > found[0] + 1e-9:
                            found = (gain, left, right)
            return found
        parts = [(best(np.arange(len(y))), np.arange(len(y)))]
        while len(parts) < leaves and max(p[0][0] for p in parts) > 0:
            k = max(range(len(parts)), key=lambda i: parts[i][0][0])
            (_, left, right), _ = parts.pop(k)
            parts += [(best(left), left), (best(right), right)]
        for _, index in parts:
            score[index] -= rate * g[index].sum() / (len(index) + l2)
    return score


COLUMNS = ["a", "b", "c"]


def test_same_as_a_plain_fit(spark):
    x, y = data(230)
    df = table(spark, x, y).repartition(5)
    fitted = trees.fit_boosted_trees(df, COLUMNS, [2, 4, 9], rounds=4, rate=.3, l2=1.0, min_rows=7)
    for leaves, model in fitted.items():
        got = np.array([r["score"] for r in trees.score_trees(model, df, COLUMNS).orderBy("id").collect()])
        assert np.allclose(got, plain_fit(x, y, leaves, 4, .3, 1.0, 7), atol=1e-9)
        assert all((t[0] == trees.LEAF).sum() <= leaves for t in model.trees)


def test_passes_of_few_nodes_and_written_scores_change_nothing(spark, monkeypatch):
    x, y = data(150)
    df = table(spark, x, y)
    one = trees.fit_boosted_trees(df, COLUMNS, [3, 8], rounds=5, min_rows=5)
    monkeypatch.setattr(trees, "CELLS", 3 * trees.BINS)
    monkeypatch.setattr(trees, "ROUNDS_PER_WRITE", 2)
    monkeypatch.setattr(trees, "DRIVER_CELLS", 0)
    monkeypatch.setattr(trees, "BYTES_PER_TASK", 100)
    two = trees.fit_boosted_trees(df.repartition(3), COLUMNS, [3, 8], rounds=5, min_rows=5)
    for k in one:
        assert np.allclose(one[k].predict(x), two[k].predict(x))
    assert not [r for r in spark.sparkContext._jsc.getPersistentRDDs().values()]


def test_many_values_are_binned_evenly(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 3))
    bounds = trees.bin_bounds(trees.feature_rows(table(spark, x, np.zeros(4000)), COLUMNS), 3)
    for f in range(3):
        sizes = np.bincount(np.searchsorted(bounds[f], x[:, f], "left"), minlength=trees.BINS)
        assert len(bounds[f]) == trees.BINS - 1 and sizes.max() < 3 * 4000 / trees.BINS


def test_saved_model_and_refusals(spark, tmp_path):
    x, y = data(120)
    df = table(spark, x, y)
    model = trees.fit_boosted_trees(df, COLUMNS, [5], rounds=3, min_rows=5)[5]
    trees.save_trees(spark, model, str(tmp_path / "m"))
    again = trees.load_trees(spark, str(tmp_path / "m"))
    want = rows(trees.score_trees(model, df, COLUMNS).select("id", "score"), "id")
    assert rows(trees.score_trees(again, df, COLUMNS).select("id", "score"), "id") == want
    with pytest.raises(Exception, match="path_already_exists|PATH_ALREADY_EXISTS"):
        trees.save_trees(spark, model, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="names"):
        trees.score_trees(model, df, ["b", "a", "c"])
    with pytest.raises(Exception, match="finite"):
        trees.fit_boosted_trees(df.withColumn("a", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("a"))), COLUMNS, [5], rounds=1)
    with pytest.raises(ValueError, match="rows"):
        trees.fit_boosted_trees(df.filter("false"), COLUMNS, [5], rounds=1)
    flat = trees.fit_boosted_trees(df.withColumn("grade", F.lit(4)), COLUMNS, [5], rounds=2, min_rows=5)[5]
    assert set(flat.predict(x)) == {4.0}


def test_selection_over_sizes(spark):
    x, y = data(300)
    df = table(spark, x, y, ["train"] * 200 + ["val"] * 100)
    best, trials, predictions = models.select_model(df, COLUMNS, [2, 7, 15], models.boosted_trees(rounds=8, rate=.3, min_rows=5))
    assert trials.count() == 3 and predictions.count() == 100
    assert trials.filter("kendall_tau_c > 0.5").count() >= 1
    val = plain_fit_tau(df, x, y, best)
    assert abs(val - trials.orderBy(F.col("kendall_tau_c").desc(), "mse", "param").first()["kendall_tau_c"]) < 1e-9


def plain_fit_tau(df, x, y, model):
    score, truth = model.predict(x[200:]), y[200:]
    sign = np.sign(score[:, None] - score) * np.sign(truth[:, None] - truth)
    m = min(len(np.unique(score)), len(np.unique(truth)))
    return sign.sum() / len(truth) ** 2 * m / (m - 1)
