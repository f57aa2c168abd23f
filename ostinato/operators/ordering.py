"""Ordered operators (row number, running sum, previous row) that split long groups.

A plain window function puts a whole group into one task. Where the largest group has more rows than
`spark.ostinato.rowsPerTask`, the rows go through Spark's range exchange by key and order instead and are
written once with the number of their partition. A partition holds a stretch of the order of one key or of a
few; the window runs per (key, partition), and one small row per partition carries the state over to the next.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.operators.skew import ROWS, row_count
from ostinato.session import rows_per_task, settled

SEG = "_seg"
ALL = "_all"


def segmented(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, bool]:
    """Add `_seg`, which follows the order within a key. False means one segment each, and nothing was written."""
    total, largest = df.groupBy(*keys).agg(row_count()).agg(F.coalesce(F.sum(ROWS), F.lit(0)), F.coalesce(F.max(ROWS), F.lit(0))).first()
    limit = rows_per_task(df.sparkSession)
    if largest <= limit:
        return df.withColumn(SEG, F.lit(0)), False
    return settled(df.repartitionByRange(-(-total // limit), *keys, *order).withColumn(SEG, F.spark_partition_id())), True


def _carry(df: DataFrame, keys: list[str], per_segment: list[Column], carried: Mapping[str, Column]) -> DataFrame:
    """`df` with the state of all earlier segments of the key.

    Only keys that lie in several segments have one: at most two rows per segment, so they may be sent to every task.
    """
    summary = df.groupBy(*keys, SEG).agg(*per_segment).withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    summary = summary.filter("_parts > 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, SEG])],
                                                  *[c.alias(n) for n, c in carried.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(F.broadcast(summary), [F.col(SEG) == F.col(f"_k{len(keys)}"), *same], "left").drop(*[f"_k{i}" for i in range(len(keys) + 1)])


def _with_all(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn(ALL, F.lit(0)), [ALL])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            new: Mapping[str, tuple[Callable[[str], Column], str]]) -> DataFrame:
    """Add for each `name: (F.sum | F.max | F.min, column)` the aggregate of all earlier rows of the key.

    Null for the first row. `order` has to be unique within a key.
    """
    df, keys = _with_all(df, keys)
    order = list(order)
    df, split = segmented(df, keys, order)
    before = Window.partitionBy(*keys, SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if split:
        earlier = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
        df = _carry(df, keys, [agg(c).alias(f"_s{i}") for i, (agg, c) in enumerate(new.values())],
                    {f"_c{i}": agg(f"_s{i}").over(earlier) for i, (agg, _) in enumerate(new.values())})
    df = df.withColumns({name: agg(column).over(before) for name, (agg, column) in new.items()})
    if split:
        both = {F.sum: lambda a, b: F.coalesce(a + b, a, b), F.max: F.greatest, F.min: F.least}
        df = df.withColumns({name: both[agg](F.col(name), F.col(f"_c{i}")) for i, (name, (agg, _)) in enumerate(new.items())})
        df = df.drop(*[f"_c{i}" for i in range(len(new))])
    return df.drop(SEG, ALL)


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Sum of each column over all earlier rows of the key, 0 for the first."""
    out = running(df, keys, order, {name: (F.sum, column) for name, column in sums.items()})
    return out.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in sums})


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add the 0-based position of each row within its key."""
    df, keys = _with_all(df, keys)
    order = list(order)
    df, split = segmented(df, keys, order)
    at = F.row_number().over(Window.partitionBy(*keys, SEG).orderBy(*order)).cast("long") - 1
    if split:
        earlier = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
        df = _carry(df, keys, [F.count(F.lit(1)).alias("_n")], {"_c": F.sum("_n").over(earlier)})
        at = at + F.coalesce(F.col("_c"), F.lit(0))
    return df.withColumn(name, at).drop(SEG, ALL, "_c")


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Add for each `new: column` the value of `column` in the row before (null for the first)."""
    df, keys = _with_all(df, keys)
    order = list(order)
    df, split = segmented(df, keys, order)
    by = Window.partitionBy(*keys, SEG).orderBy(*order)
    here = {name: F.lag(column).over(by) for name, column in columns.items()}
    if split:
        last = F.max_by(F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns.values())]), F.struct(*order)).alias("_last")
        df = _carry(df, keys, [last], {"_c": F.lag("_last").over(Window.partitionBy(*keys).orderBy(SEG))})
        first = F.row_number().over(by) == 1
        here = {name: F.when(first, F.col(f"_c.v{i}")).otherwise(value) for i, (name, value) in enumerate(here.items())}
    return df.withColumns(here).drop("_c", SEG, ALL)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, named: Mapping[str, float],
                      also: Sequence[Column] = ()) -> DataFrame:
    """Exact linear percentiles per key, with the aggregates `also`, one row per key; nulls do not count.

    Keys that fit into a task use the built-in aggregate, in the same pass as `also`. Larger keys are
    reduced to counts per value; the wanted ranks are then found with running counts.
    """
    keys = list(keys)
    builtin = [F.percentile(value, F.lit(f)).alias(n) for n, f in named.items()]
    limit = rows_per_task(df.sparkSession)
    sizes = df.groupBy(*keys).agg(F.count(value).alias(ROWS))
    largest = sizes.agg(F.coalesce(F.max(ROWS), F.lit(0))).first()[0]
    if largest <= limit:
        return df.groupBy(*keys).agg(*also, *builtin)
    hot = F.broadcast(sizes.filter(F.col(ROWS) > limit))
    values = df.select(*keys, value)
    cold = values.join(hot.select(*keys), keys, "left_anti").groupBy(*keys).agg(*builtin)
    counts = (values.filter(F.col(value).isNotNull()).join(hot.select(*keys), keys, "left_semi")
              .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))
    ranked = running_sums(counts, keys, [value], {"_before": "_c"}).join(hot, keys)
    picks = []
    for i, fraction in enumerate(named.values()):
        at = (F.col(ROWS) - 1) * F.lit(float(fraction))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{side}{i}"))
    found = ranked.groupBy(*keys).agg(F.first(ROWS).alias(ROWS), *picks)
    results = []
    for i, (name, fraction) in enumerate(named.items()):
        at = (F.col(ROWS) - 1) * F.lit(float(fraction))
        # the built-in aggregate's own formula, so that a key's size does not show in the last digit
        between = (F.ceil(at) - at) * F.col(f"_lo{i}") + (at - F.floor(at)) * F.col(f"_hi{i}")
        results.append(F.when(F.floor(at) == F.ceil(at), F.col(f"_lo{i}")).otherwise(between).alias(name))
    all_keys = cold.unionByName(found.select(*keys, *results))
    return df.groupBy(*keys).agg(*also).join(all_keys, keys) if also else all_keys
