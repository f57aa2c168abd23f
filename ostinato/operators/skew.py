"""Joins of rows with a per-key summary that stay balanced when one key dominates.

Adaptive skew handling does not apply to "aggregate, then join back": the aggregated side is not a
bare shuffle, so Spark leaves a hot key in one task. The helpers here look at the size of the summary
and of the largest key first and choose the plan from that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.session import broadcast_keys, kept, rows_per_task

ROWS = "_rows"


def row_count():
    """Aggregate that `attach` expects in every per-key summary."""
    return F.count(F.lit(1)).alias(ROWS)


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner", keep: bool = True) -> DataFrame:
    """Add the columns of `per_key` (unique on `keys`, with `_rows` = rows of the key in `df`).

    Few keys: broadcast, its size having been counted. Many keys: shuffle join, except that keys
    larger than one task may hold are joined by broadcast; there are at most rows / rows_per_task.
    `keep` holds the summary for its second use; not needed where it is a written table.
    """
    spark = df.sparkSession
    keys = list(keys)
    limit = rows_per_task(spark)
    # one row per key, read by the look below and by the join; spills to disk, recomputed where lost
    if keep:
        per_key = kept(per_key)
    n_keys, largest = per_key.agg(F.count(F.lit(1)), F.coalesce(F.max(ROWS), F.lit(0))).first()
    summary = per_key.drop(ROWS)
    if n_keys <= broadcast_keys(spark):
        return df.join(F.broadcast(summary), keys, how)
    if largest <= limit:
        return df.join(summary, keys, how)
    hot = per_key.filter(F.col(ROWS) > limit).drop(ROWS)
    cold = per_key.filter(F.col(ROWS) <= limit).drop(ROWS)
    hot_keys = F.broadcast(hot.select(*keys))
    in_hot = df.join(F.broadcast(hot), keys, "inner")
    in_cold = df.join(hot_keys, keys, "left_anti").join(cold, keys, how)
    return in_hot.unionByName(in_cold)


def restrict(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `df` whose key occurs in `wanted`, with the same care for size and hot keys as `attach`."""
    keys = list(keys)
    unique = wanted.select(*keys).distinct()
    if unique.count() <= broadcast_keys(df.sparkSession):
        return df.join(F.broadcast(unique), keys, "left_semi")
    sizes = df.groupBy(*keys).agg(row_count()).join(unique, keys, "left_semi")
    return attach(df, sizes, keys)
