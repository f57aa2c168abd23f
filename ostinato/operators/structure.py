"""Self-similarity of a series after pooling its time axis.

Pooling bounds a series to `columns` frames, so its similarity matrix is a bounded value of one row.
The matrix is computed inside the row; pairs are never joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ostinato.functions.columns import unit_vector
from ostinato.operators.windows import gather_vectors, time_pool

# Pooled length, profile length, recurrence level, half width of the novelty kernel.
COLUMNS = 256
LAGS = 64
RECURRENCE = 0.75
NOVELTY_HALF = 8


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _gram(vectors: pd.Series) -> pd.Series:
    def one(rows):
        x = np.stack([np.asarray(r, float) for r in rows])
        return list(x @ x.T)
    return pd.Series([one(v) for v in vectors])


def similarity(frames: DataFrame, columns: int = COLUMNS, normalize: bool = True) -> DataFrame:
    """One row per series: id, n and the matrix `sim` of the pooled frames; needs two frames."""
    if normalize:
        frames = frames.withColumn("values", unit_vector(F.transform("values", lambda x: x.cast("double"))))
    pooled = gather_vectors(time_pool(frames, columns), ["id", "bucket"])
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "values")))
    rows = pooled.groupBy("id").agg(F.transform(ordered, lambda r: r["values"]).alias("vectors"))
    n = F.size("vectors")
    enough = F.when(n >= 2, F.col("vectors")).otherwise(
        F.raise_error(F.lit("a series needs at least two frames")).cast("array<array<double>>"))
    return rows.select("id", n.cast("long").alias("n"), _gram(enough).alias("sim"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _mean(values: Column) -> Column:
    return _total(values) / F.size(values)


def _std(values: Column, mean: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / F.size(values))


def similarity_pairs(frames: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """Long form of the upper triangle with the diagonal: id, i, j, sim."""
    rows = similarity(frames, columns).select("id", F.posexplode("sim").alias("i", "row"))
    return rows.select("id", "i", F.posexplode("row").alias("j", "sim")).filter("i <= j")


def ssm_stats(frames: DataFrame, columns: int = COLUMNS, level: float = RECURRENCE) -> DataFrame:
    """Mean, population deviation and share at or above `level` of the strict upper triangle."""
    upper = F.flatten(F.transform("sim", lambda row, i: F.slice(row, i + 2, F.greatest(F.size(row) - i - 1, F.lit(0)))))
    flat = similarity(frames, columns).select("id", upper.alias("off"))
    flat = flat.withColumn("ssm_mean", _mean(F.col("off")))
    return flat.select("id", "ssm_mean", _std(F.col("off"), F.col("ssm_mean")).alias("ssm_std"),
                       (F.size(F.filter("off", lambda x: x >= level)) / F.size("off")).alias("recurrence_rate"))


def _lag_means(lags: int) -> Column:
    n = F.col("n").cast("int")
    diagonal = lambda lag: F.aggregate(
        F.sequence(F.lit(0), n - lag - 1), F.lit(0.0),
        lambda acc, i: acc + F.get(F.get(F.col("sim"), i), i + lag)) / (n - lag)
    return F.transform(F.sequence(F.lit(1), F.lit(lags)), lambda lag: F.when(lag < n, diagonal(lag)).otherwise(0.0))


def ssm_lags(frames: DataFrame, columns: int = COLUMNS, lags: int = LAGS) -> DataFrame:
    """Mean of each diagonal 1..lags (0 past the end): id, lag, value."""
    rows = similarity(frames, columns).select("id", F.posexplode(_lag_means(lags)).alias("lag", "value"))
    return rows.select("id", (F.col("lag") + 1).alias("lag"), "value")


def ssm_lag_summary(frames: DataFrame, columns: int = COLUMNS, lags: int = LAGS) -> DataFrame:
    rows = similarity(frames, columns).select("id", _lag_means(lags).alias("p"))
    rows = rows.withColumn("lag_profile_mean", _mean(F.col("p")))
    return rows.select("id", "lag_profile_mean", _std(F.col("p"), F.col("lag_profile_mean")).alias("lag_profile_std"),
                       F.array_max("p").alias("lag_profile_max"))


def _novelty_curve(half: int) -> Column:
    """Minus the mean similarity between the `half` frames before and from each frame on, then minus the minimum."""
    n = F.col("n").cast("int")

    def at(i: Column) -> Column:
        a0, b1 = F.greatest(F.lit(0), i - half), F.least(n, i + half)
        block = F.transform(F.slice(F.col("sim"), a0 + 1, i - a0), lambda row: _total(F.slice(row, i + 1, b1 - i)))
        return F.when(i == 0, F.lit(0.0)).otherwise(-_total(block) / ((i - a0) * (b1 - i)))

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def novelty_rows(frames: DataFrame, columns: int = COLUMNS, half: int = NOVELTY_HALF) -> DataFrame:
    """One row per series with the novelty curve as an array."""
    raw = similarity(frames, columns).select("id", "n", _novelty_curve(half).alias("raw"))
    low = F.array_min("raw")
    return raw.select("id", "n", F.transform("raw", lambda x: x - low).alias("novelty"))


def novelty(frames: DataFrame, columns: int = COLUMNS, half: int = NOVELTY_HALF) -> DataFrame:
    """Long novelty curve: id, i, novelty."""
    return novelty_rows(frames, columns, half).select("id", F.posexplode("novelty").alias("i", "novelty"))


def novelty_peaks(frames: DataFrame, durations: DataFrame, columns: int = COLUMNS, half: int = NOVELTY_HALF) -> DataFrame:
    """Mean, deviation and peaks per second of the novelty; a peak is above both neighbours and mean + std."""
    rows = novelty_rows(frames, columns, half)
    rows = rows.withColumn("novelty_mean", _mean(F.col("novelty")))
    rows = rows.withColumn("novelty_std", _std(F.col("novelty"), F.col("novelty_mean")))
    level = F.col("novelty_mean") + F.col("novelty_std")
    around = lambda i: (F.get(F.col("novelty"), i - 1), F.get(F.col("novelty"), i), F.get(F.col("novelty"), i + 1))

    def is_peak(i: Column) -> Column:
        left, here, right = around(i)
        return (here > left) & (here > right) & (here > level)

    inner = F.sequence(F.lit(1), F.col("n").cast("int") - 2)
    count = F.when((F.col("n") >= 3) & (F.col("novelty_std") > 0), F.size(F.filter(inner, is_peak))).otherwise(0)
    timed = rows.withColumn("peaks", count).join(durations.select("id", "duration"), "id")
    density = F.when(F.col("duration") > 0, F.col("peaks") / F.col("duration")).otherwise(0.0)
    return timed.select("id", "novelty_mean", "novelty_std", F.col("peaks").cast("long").alias("peaks"),
                        density.alias("novelty_peak_density"))


def best_repeat(frames: DataFrame, durations: DataFrame, columns: int = COLUMNS, window_seconds: float = 8.0) -> DataFrame:
    """Most similar pair of frames at least max(3, n/10) apart, the first of equals, with its time bounds."""
    n = F.col("n").cast("int")
    apart = F.greatest(F.lit(3), F.floor(n / 10).cast("int"))
    # per row i the best j, of equals the smallest; then the best i in the same way
    per_row = F.transform("sim", lambda row, i: F.array_max(F.transform(
        F.slice(row, i + apart + 1, F.greatest(F.size(row) - i - apart, F.lit(0))),
        lambda v, k: F.struct(v.alias("sim"), (-i).alias("i"), (-(i + apart + k)).alias("j")))))
    rows = similarity(frames, columns).select("id", "n", F.array_max(per_row).alias("b"))
    timed = rows.join(durations.select("id", "duration"), "id")
    i, j = -F.col("b.i"), -F.col("b.j")
    step = F.col("duration") / n
    half = F.greatest(F.lit(1), F.rint(F.lit(float(window_seconds)) / F.greatest(step, F.lit(1e-6)) / 2).cast("int"))
    t0 = lambda c: F.greatest(F.lit(0), c - half) * step
    t1 = lambda c: F.least(n - 1, c + half) * step + step
    found = F.col("b").isNotNull()
    i, j = F.when(found, i).otherwise(0), F.when(found, j).otherwise(0)
    return timed.select("id", F.coalesce(F.col("b.sim"), F.lit(-1.0)).alias("sim"), i.cast("long").alias("i"), j.cast("long").alias("j"),
                        t0(i).alias("a_start"), t1(i).alias("a_end"), t0(j).alias("b_start"), t1(j).alias("b_end"))
