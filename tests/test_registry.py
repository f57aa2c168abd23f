import hashlib
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from ostinato.operators import registry

HISTORY = "run string, epoch int, tau_c double, mse double"


def history(spark, taus, mses=None, run="r"):
    mses = mses or [1.0] * len(taus)
    return spark.createDataFrame([(run, i + 1, t, m) for i, (t, m) in enumerate(zip(taus, mses))], HISTORY)


def replay(spark, taus, patience, delta):
    r = registry.early_stop(history(spark, taus), patience, delta).first()
    return r["epochs_run"], r["stopped"]


def test_known_sequences(spark):
    assert replay(spark, [.5] * 20, 15, .001) == (16, True)
    assert replay(spark, [.5, .5004, .5008, .5012, .4, .5013, .5014, .9], 3, .001) == (7, True)
    assert replay(spark, [.4, .40000001, .40000001, .40000001, .9], 2, 0) == (4, True)
    assert replay(spark, [None, None, .5], 2, .001) == (2, True)
    assert replay(spark, [.1, .2, .3], 2, .001) == (3, False)


def stop_by_last_gain(taus, patience, delta):
    """Stated by the positions of the gains: the replay ends `patience` epochs after the last one that has no successor in reach."""
    last, ref = -1, None
    while True:
        ahead = [j for j in range(last + 1, min(len(taus), last + patience + 1))
                 if taus[j] is not None and (ref is None or (taus[j] > ref and taus[j] - ref >= delta))]
        if not ahead:
            return min(len(taus), last + patience + 1), last + patience < len(taus), ref
        last, ref = ahead[0], taus[ahead[0]]


@pytest.mark.parametrize("delta", [0.0, 0.02, 0.3])
@pytest.mark.parametrize("limit", [10, 10_000])
def test_replay_against_a_loop(spark, small_tasks, delta, limit):
    rng = random.Random(8)
    series = {f"r{k}": [None if rng.random() < .1 else rng.random() * min(1, i / 60) for i in range(90)] for k in range(6)}
    df = None
    for k, taus in series.items():
        part = history(spark, taus, run=k)
        df = part if df is None else df.unionByName(part)
    with small_tasks(limit):
        got = {r["run"]: (r["epochs_run"], r["stopped"], r["reference_tau"]) for r in registry.early_stop(df, 7, delta).collect()}
    assert got == {k: stop_by_last_gain(t, 7, delta) for k, t in series.items()}


@pytest.mark.parametrize("patience,delta", [(0, .001), (-1, .001), (3, -.1), (3, float("nan")), (3, float("inf"))])
def test_bad_parameters(spark, patience, delta):
    with pytest.raises(ValueError):
        registry.early_stop(history(spark, [.1]), patience, delta)


def test_tau_must_be_finite(spark):
    with pytest.raises(Exception, match="finite"):
        registry.early_stop(history(spark, [float("nan")])).collect()


def test_best_epoch_and_trial(spark):
    best = registry.best_epoch(history(spark, [.5, .5002, .5004, .5004, None], [4., 3., 2., 2., 0.])).first()
    assert best["epoch"] == 3
    assert registry.best_epoch(history(spark, [None, None], [4., 3.])).first()["epoch"] == 2
    trials = spark.createDataFrame([(1.0, .5, 2.0), (2.0, .5, 1.0), (3.0, None, .1), (0.5, .5, 1.0)], "param double, kendall_tau_c double, mse double")
    assert registry.best_trial(trials).first()["param"] == 0.5
    with pytest.raises(Exception, match="no candidate"):
        registry.best_trial(trials.filter("param = 3.0")).collect()


def wide(spark):
    rng = random.Random(2)
    data = [(f"p{i:03d}", rng.randint(0, 10)) for i in range(60)]
    return spark.createDataFrame([(k, y, *[y + round(rng.gauss(0, 2), 2) for _ in range(4)]) for k, y in data],
                                 "id string, truth int, b double, r double, s double, f double")


def cases_by_hand(table, k=3):
    err = lambda row, m: abs(row[m] - row["truth"])
    cats = [("baseline_large_err", lambda x: True, lambda x: err(x, "b"), 4)]
    for name, m in (("structure", "s"), ("rhythm", "r")):
        cats.append((f"{name}_improved", lambda x, m=m: err(x, m) - err(x, "b") < -.5, lambda x, m=m: err(x, "b") - err(x, m), k))
        cats.append((f"{name}_worsened", lambda x, m=m: err(x, m) - err(x, "b") > .5, lambda x, m=m: err(x, m) - err(x, "b"), k))
    cats.append(("full_still_bad", lambda x: err(x, "f") >= 2, lambda x: err(x, "f"), k))
    out, seen = [], set()
    for name, rule, score, n in cats:
        for row in sorted(filter(rule, table), key=lambda x: (-score(x), x["id"]))[:n]:
            if row["id"] not in seen:
                seen.add(row["id"])
                out.append((name, row["id"]))
    return out


def test_cases_and_examples(spark):
    df = wide(spark)
    table = [r.asDict() for r in df.collect()]
    cases = registry.pick_cases(df, "b", "r", "s", "f").cache()
    ordered = [(r["category"], r["id"]) for r in cases.orderBy("place", "rank").collect()]
    assert ordered == cases_by_hand(table)
    pieces = spark.createDataFrame([("p001", ["a"] * 4), ("p000", ["a"]), ("p009", ["a"] * 5)], "id string, yt_chapters array<string>")
    errors = [r["id"] for r in registry.pick_examples("errors", cases).orderBy("position").collect()]
    assert errors == [k for _, k in ordered][:6]
    got = [(r["id"], r["reason"]) for r in registry.pick_examples("structure", cases, df, pieces, "b", "s").orderBy("position").collect()]
    gap = lambda x: abs(x["s"] - x["truth"]) - abs(x["b"] - x["truth"])
    by_gap = [x["id"] for x in sorted(table, key=lambda x: (gap(x), x["id"]))]
    by_loss = [x["id"] for x in sorted(table, key=lambda x: (-gap(x), x["id"]))]
    want = [(k, "structure_improved") for k in by_gap[:2]] + [(k, "structure_worsened") for k in by_loss[:2]] + [("p001", "has_chapters")]
    want += [(k, f"from_error:{c}") for c, k in ordered if k not in {w[0] for w in want}]
    assert got == want[:6]
    merged = [r["id"] for r in registry.pick_examples("merged", cases, df, pieces, "b", "s").orderBy("position").collect()]
    picks, seen = [k for k, _ in want[:6]], {k for k, _ in want[:6]}
    for _, k in ordered:
        if k in seen:
            continue
        picks.append(k)
        seen.add(k)
        if sum(e in seen for e in errors) >= 6 and len(picks) >= 6:
            break
    assert merged == picks
    with pytest.raises(ValueError):
        registry.pick_examples("other", cases, df, pieces, "b", "s")


def test_selection(spark):
    df = spark.createDataFrame([("a", "g"), ("b", "h")], "id string, group string")
    assert rows(registry.select_experiments(df, ["a"])) == [("a", "g")]
    assert rows(registry.select_experiments(df, group="h")) == [("b", "h")]
    for args in (dict(ids=["z"]), dict(group="z"), dict(ids=["a"], group="h")):
        with pytest.raises(ValueError):
            registry.select_experiments(df, **args)


def test_manifest_and_index(spark):
    cols = "id string, label int, status string, cqt_sha256 string, rhythm_sha256 string"
    manifest = spark.createDataFrame([("a", 1, "included", "x", "y"), ("b", 1, "excluded", "x", "y"), ("c", 2, "included", "x", "y"),
                                      ("d", 1, "included", "x", "z")], cols)
    items = spark.createDataFrame([(k, 1, "x", "y") for k in "abcde"], "id string, label int, cqt_sha256 string, rhythm_sha256 string")
    assert rows(registry.verify_manifest(items, manifest), "id") == [("b", "not_included"), ("c", "label_differs"), ("d", "content_changed"), ("e", "absent")]
    windows = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    labels = spark.createDataFrame([("a", 1, "h"), ("b", 2, "h")], "id string, y int, audio_sha256 string")
    index = registry.window_index(windows, labels, 4.0, .2)
    assert registry.verify_index(windows, index, labels, 4.0, .2).count() == 0
    assert rows(registry.verify_index(windows.limit(2).union(windows.filter("id = 'b'")).union(windows.filter("id = 'b'")), index, labels, 4.0, .2)) == [("b", "length_differs")]
    assert registry.verify_index(windows, index, labels, 4.0, .5).count() == 2


def test_run_tables(spark, small_tasks):
    runs = spark.createDataFrame([(f"r{i}", "a", "completed" if i % 2 else None, None if i % 3 else "s", 5 if i % 2 else None, .1 * i, i == 1) for i in range(40)],
                                 "run string, experiment_id string, status string, split_sha256 string, n_validation int, kendall_tau_c double, test_evaluated boolean")
    exps = spark.createDataFrame([("a",), ("b",)], "experiment_id string")
    with small_tasks(5):
        status = registry.run_status(exps, runs)
        assert status.count() == 41 and status.filter("status = 'not_started'").count() == 1
        assert status.filter("status = 'unmanaged'").count() == 20
        members = registry.comparable_members(runs)
        assert members.count() == 40
    groups = {(r["split_sha256"], r["n_validation"]): r["n_runs"] for r in registry.comparable(runs).collect()}
    assert sum(groups.values()) == 40 and set(k[0] for k in groups) == {"s", "unknown"}
    summary = dict(rows(registry.registry_summary(runs)))
    assert summary["runs"] == 40 and summary["test_evaluated"] == 1 and summary["n_validation=5"] == 20
    board = registry.leaderboard(spark.createDataFrame([("b", .5), ("a", .5), ("c", None), ("d", .9)], "run string, kendall_tau_c double"))
    assert [r["run"] for r in board.collect()] == ["d", "a", "b", "c"]


def test_digests(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "id string")
    big = spark.range(3000).selectExpr("cast(id as string) as id")

    def by_hand(ids):
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        rows = sorted((sha(i)[:8], sha(i)) for i in set(ids))
        for digits in (8, 6, 4, 2, 0):
            groups = {}
            for p, h in sorted(rows):
                groups.setdefault(p[:digits], []).append(h)
            rows = [(p, sha("\n".join(hs))) for p, hs in groups.items()]
        return rows[0][1]

    assert registry.ids_digest(df).first()["digest"] == by_hand("abc")
    one = registry.ids_digest(big).first()["digest"]
    assert one == by_hand(map(str, range(3000))) == registry.ids_digest(big.repartition(7).orderBy(F.desc("id"))).first()["digest"]
    assert one != registry.ids_digest(big.filter("id != '7'")).first()["digest"]


@pytest.mark.parametrize("delta, patience, block", [(1e-9, 4, 5), (0.0, 3, 4), (0.2, 9, 4), (1e-9, 700, 16)])
def test_many_small_gains_over_more_epochs_than_a_task_holds(spark, small_tasks, delta, patience, block):
    rng = random.Random(patience)
    taus = [None if rng.random() < .3 else i / 1000 + rng.random() / 500 for i in range(600)]
    with small_tasks(40):
        got = registry.early_stop(history(spark, taus).repartition(3), patience, delta, block=block).first()
    assert (got["epochs_run"], got["stopped"], got["reference_tau"]) == stop_by_last_gain(taus, patience, delta)


def test_no_known_tau(spark):
    r = registry.early_stop(history(spark, [None] * 5), 9, .1).first()
    assert (r["epochs_run"], r["stopped"], r["reference_tau"]) == (5, False, None)
