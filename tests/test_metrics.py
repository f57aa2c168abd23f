import random

import pytest

from conftest import rows
from ostinato.operators import metrics


def scored(spark, truth, score):
    return spark.createDataFrame([("m", i, int(y), float(s)) for i, (y, s) in enumerate(zip(truth, score))],
                                 "model string, id long, truth int, score double")


def test_tau_with_ties(spark):
    got = metrics.evaluate(scored(spark, [0, 0, 1, 2], [0, .1, 1, 2])).first()
    assert got["kendall_tau_c"] == pytest.approx(0.9375)
    assert got["n"] == 4 and got["correlation_note"] is None


def test_raw_errors_and_rounded_accuracy(spark):
    got = metrics.evaluate(scored(spark, [0, 10], [1.5, 20])).first()
    assert got["acc_pm1"] == 0.5 and got["mse"] == pytest.approx((2.25 + 100) / 2)


def test_constant_scores_have_no_correlation(spark):
    got = metrics.evaluate(scored(spark, [0, 1, 2], [1, 1, 1])).first()
    assert got["kendall_tau_c"] is None and got["spearman"] is None and got["mse"] == pytest.approx(2 / 3)
    assert got["correlation_note"]


@pytest.mark.parametrize("truth,score", [([0, 1], [float("nan"), 1]), ([0, 1], [float("inf"), 1]), ([0, 11], [0, 1])])
def test_bad_inputs_are_refused(spark, truth, score):
    with pytest.raises(Exception, match="finite"):
        metrics.evaluate(scored(spark, truth, score)).collect()


def brute_force(truth, score):
    n = len(truth)
    sign = lambda x: (x > 0) - (x < 0)
    pq = sum(sign(truth[i] - truth[j]) * sign(score[i] - score[j]) for i in range(n) for j in range(i))
    m = min(len(set(truth)), len(set(score)))
    rank = lambda xs: [sum(b < a for b in xs) + (sum(b == a for b in xs) + 1) / 2 for a in xs]
    a, b = rank(truth), rank(score)
    ma, mb = sum(a) / n, sum(b) / n
    cov = sum((x - ma) * (y - mb) for x, y in zip(a, b))
    return 2 * pq / (n * n * (m - 1) / m), cov / (sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) ** .5


@pytest.mark.parametrize("rows_limit", [20, 10_000])
def test_ranks_against_brute_force(spark, small_tasks, rows_limit):
    rng = random.Random(5)
    truth = [rng.choice([0, 2, 3, 7, 10]) for _ in range(220)]
    score = [round(t + rng.gauss(0, 3), 1) for t in truth]
    with small_tasks(rows_limit):
        got = metrics.rank_metrics(scored(spark, truth, score), ["model"]).first()
    tau, rho = brute_force(truth, score)
    assert got["kendall_tau_c"] == pytest.approx(tau, abs=1e-12)
    assert got["spearman"] == pytest.approx(rho, abs=1e-12)


def test_separate_ranking_score(spark):
    df = scored(spark, [0, 1, 2], [2, 1, 0]).selectExpr("*", "-score as other")
    got = metrics.evaluate(df, ranking="other").first()
    assert got["spearman"] == pytest.approx(1.0) and got["mae"] == pytest.approx(4 / 3)


def test_pivot_needs_one_truth(spark):
    df = spark.createDataFrame([("a", "x", 1, 0.5), ("b", "x", 2, 0.7)], "model string, id string, truth int, score double")
    with pytest.raises(Exception, match="disagree"):
        metrics.pivot_predictions(df, ["a", "b"]).collect()


def test_verification_finds_each_problem(spark):
    good = scored(spark, [0, 1, 2], [0, 1.5, 2]).drop("model")
    members = good.selectExpr("id", "truth as grade")
    reported = metrics.evaluate(good)
    assert metrics.verify_predictions(good, members, reported).count() == 0
    bad = good.filter("id != 0").unionByName(good.filter("id = 1"))
    found = {(r["subject"], r["problem"]) for r in metrics.verify_predictions(bad, members, reported).collect()}
    assert ("0", "missing_prediction") in found and ("1", "duplicate_id") in found and ("n", "metric_differs") not in found
    other = members.selectExpr("id", "case when id = 2 then 9 else grade end as grade")
    assert [tuple(r) for r in metrics.verify_predictions(good, other, reported).collect()] == [("2", "label_differs")]


def test_mean_baseline(spark):
    df = spark.createDataFrame([("train", 2), ("train", 4), ("val", 3), ("val", 5)], "part string, truth int")
    got = metrics.mean_baseline(df).first()
    assert got["part"] == "val" and got["mae"] == 1.0 and got["kendall_tau_c"] is None


def test_grade_stats_use_raw_error(spark):
    got = {(r["level"], r["grade"], r["band"]): r for r in metrics.grade_stats(scored(spark, [0, 0, 5], [1.2, 0.5, 5])).collect()}
    assert got[("grade", 0, None)]["acc_pm1"] == 0.5
    assert got[("band", None, "Mid4-6")]["n"] == 1
    assert got[("overall", None, None)]["bias"] == pytest.approx(1.7 / 3)


def test_release_claims(spark):
    members = spark.createDataFrame([("1", 3), ("2", 5)], "id string, grade int")
    good = spark.createDataFrame([("1", 3, 2.5), ("2", 5, 5.5)], "id string, truth int, score double")
    split = spark.createDataFrame([("0", "train"), ("1", "val"), ("2", "val")], "id string, part string")
    reported = metrics.evaluate(good)
    claims = {"split_sha256": "s", "seed": 42, "n_train": 1, "n_val": 2}
    assert metrics.verify_release(good, members, reported, claims, split, "s", 42).count() == 0
    for changed, found in (({"split_sha256": "t"}, "split_sha256"), ({"seed": 7}, "seed"), ({"n_val": 3}, "n_val"), ({"n_test": 4}, "n_test")):
        got = metrics.verify_release(good, members, reported, claims | changed, split, "s", 42)
        assert [tuple(r) for r in got.collect()] == [(found, f"{found}_differs")]
    without = {k: v for k, v in claims.items() if k != "seed"}
    both = metrics.verify_release(good.filter("id = '1'"), members, metrics.evaluate(good.filter("id = '1'")), without, split, "s", 42)
    assert sorted(tuple(r) for r in both.collect()) == [("2", "missing_prediction"), ("seed", "seed_differs")]
