"""Split groups against plain windows, on data where one key holds most rows."""
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from ostinato.operators.blocks import with_halo
from ostinato.operators.ordering import exact_percentiles, positions, previous, running, running_sums, segmented
from ostinato.operators.skew import attach, restrict, row_count


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    out = []
    for i in range(900):
        key = "hot" if i % 3 else rng.choice(["a", "b", "c", "d"])
        out.append((key, float(rng.randint(0, 40)), i, rng.randint(-5, 9)))
    rng.shuffle(out)
    return spark.createDataFrame(out, "k string, t double, n long, v long").repartition(5).cache()


def test_segments_follow_the_order_and_stay_small(data, small_tasks):
    with small_tasks():
        cut, split = segmented(data, ["k"], ["t", "n"])
        assert split
        hot = rows(cut.filter("k = 'hot'").select("t", "n", "_seg"), "t", "n")
        segs = [s for _, _, s in hot]
        assert segs == sorted(segs) and len(set(segs)) > 15
        sizes = np.bincount(segs)
        assert sizes.max() < 80
    assert not segmented(data, ["k"], ["t", "n"])[1]


def test_one_value_held_by_many_rows_is_cut_by_the_tie(spark, small_tasks):
    df = spark.range(500).select(F.lit("x").alias("k"), F.lit(1.0).alias("t"), F.col("id").alias("n"))
    with small_tasks():
        cut, split = segmented(df, ["k"], ["t", "n"])
        assert split and cut.select("_seg").distinct().count() > 10
        assert rows(positions(df, ["k"], ["t", "n"], "p").filter("p != n")) == []


def test_running_positions_previous(data, small_tasks):
    w = Window.partitionBy("k").orderBy("t", "n")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = data.select("k", "n", F.coalesce(F.sum("v").over(before), F.lit(0)), F.max("v").over(before),
                       F.row_number().over(w) - 1, F.lag("v").over(w), F.lag("t").over(w))
    with small_tasks():
        got = running_sums(data, ["k"], ["t", "n"], {"s": "v"})
        got = running(got, ["k"], ["t", "n"], {"m": (F.max, "v")})
        got = positions(got, ["k"], ["t", "n"], "p")
        got = previous(got, ["k"], ["t", "n"], {"pv": "v", "pt": "t"})
        assert rows(got.select("k", "n", "s", "m", "p", "pv", "pt"), "n") == rows(want, "n")


def test_whole_table_order(data, small_tasks):
    want = rows(data.select("n", (F.row_number().over(Window.orderBy("t", "n")) - 1).alias("p")), "n")
    with small_tasks():
        assert rows(positions(data, [], ["t", "n"], "p").select("n", "p"), "n") == want
    assert rows(positions(data, [], ["t", "n"], "p").select("n", "p"), "n") == want


def test_percentiles_of_hot_keys_are_exact(data, small_tasks):
    named = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    pdf = data.toPandas()
    with small_tasks():
        got = {r["k"]: r for r in exact_percentiles(data, ["k"], "t", named).collect()}
    assert set(got) == set(pdf["k"])
    for k, part in pdf.groupby("k"):
        for name, f in named.items():
            assert got[k][name] == pytest.approx(np.percentile(part["t"], 100 * f))


@pytest.mark.parametrize("rows_limit,keys_limit", [(25, 0), (10_000, 0), (25, 100)])
def test_attach_and_restrict_keep_every_row(data, small_tasks, rows_limit, keys_limit):
    sums = data.groupBy("k").agg(F.sum("v").alias("s"), row_count())
    want = rows(data.join(data.groupBy("k").agg(F.sum("v").alias("s")), "k").select("n", "s"), "n")
    wanted = data.filter("k in ('hot', 'a')").select("k")
    with small_tasks(rows_limit, keys_limit):
        assert rows(attach(data, sums, ["k"]).select("n", "s"), "n") == want
        assert rows(restrict(data, wanted, ["k"]).select("n"), "n") == rows(data.filter("k in ('hot', 'a')").select("n"), "n")


def test_halo_gives_each_block_its_neighbours(spark):
    df = spark.range(23).select(F.lit("x").alias("id"), F.col("id").alias("frame"))
    out = with_halo(df, "frame", before=2, after=3, block=5)
    blocks = {r["_block"]: sorted(r["f"]) for r in out.groupBy("_block").agg(F.collect_list("frame").alias("f")).collect()}
    for b in range(5):
        assert blocks[b] == [f for f in range(23) if b * 5 - 2 <= f <= b * 5 + 4 + 3]
    assert sorted(r["frame"] for r in out.filter("_core").collect()) == list(range(23))


def test_split_plans_have_no_nested_loop(data, small_tasks):
    with small_tasks(40):
        for df in (positions(data, [], ["t", "n"], "p"), running_sums(data, [], ["t", "n"], {"s": "v"}), previous(data, ["k"], ["t", "n"], {"pv": "v"})):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_null_keys_are_split_too(spark, small_tasks):
    df = spark.range(300).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("n"), F.lit(1).alias("one"))
    with small_tasks(40):
        assert rows(running_sums(df, ["k"], ["n"], {"s": "one"}).filter("s != n")) == []
        assert rows(positions(df, ["k"], ["n"], "p").filter("p != n")) == []
