"""Overlapping windows over a dense frame index, with a forced last window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.operators.skew import ROWS, attach

NOT_DENSE = "frame index must be 0..n-1 without gaps"


def _require_sizes(*sizes: int) -> None:
    if any(s <= 0 for s in sizes):
        raise ValueError("window sizes must be positive")


def series_lengths(df: DataFrame, key: str = "id", index: str = "frame") -> DataFrame:
    """Frames per series; fails where the index is not 0..n-1, each number once.

    Numbers meet as bits of words of 64, most of them before the shuffle; a word with fewer bits than rows has seen one twice.
    """
    at = F.col(index).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    words = df.groupBy(key, F.floor(at / 64).alias("_word")).agg(
        F.bit_or(bit).alias("_bits"), F.count(F.lit(1)).alias("_times"), F.min(at).alias("_low"), F.max(at).alias("_high"))
    n = F.max("_high") + 1
    dense = F.bool_and(F.coalesce(F.bit_count("_bits") == F.col("_times"), F.lit(False))) & (F.sum("_times") == n) & (F.min("_low") == 0)
    checked = F.when(dense, n).otherwise(F.raise_error(F.lit(NOT_DENSE)).cast("long"))
    return words.groupBy(key).agg(checked.alias("n"), F.sum("_times").alias(ROWS))


def window_starts(n: Column, win: int, hop: int) -> Column:
    """All starts of a series of n frames: every hop, and the last full window."""
    _require_sizes(win, hop)
    regular = F.sequence(F.lit(0).cast("long"), F.greatest(n - win, F.lit(0)).cast("long"), F.lit(hop).cast("long"))
    tail = F.when((n > win) & ((n - win) % hop != 0), F.array((n - win).cast("long"))).otherwise(
        F.array().cast("array<bigint>"))
    return F.concat(regular, tail)


def covering_starts(frame: Column, n: Column, win: int, hop: int) -> Column:
    """Starts of the windows that contain a frame."""
    _require_sizes(win, hop)
    frame, n = frame.cast("long"), n.cast("long")
    last = F.greatest(n - win, F.lit(0))
    low = F.greatest(F.lit(0), F.ceil((frame - (win - 1)) / hop))
    high = F.floor(F.least(frame, last) / hop)
    none = F.array().cast("array<bigint>")
    regular = F.when(low <= high, F.transform(F.sequence(low.cast("long"), high.cast("long")), lambda k: k * hop)).otherwise(none)
    tail = F.when((last % hop != 0) & (frame >= last), F.array(last)).otherwise(none)
    return F.concat(regular, tail)


def frame_windows(frames: DataFrame, win: int, hop: int) -> DataFrame:
    """One row per (window, frame): adds `n` and `start`."""
    sized = attach(frames, series_lengths(frames), ["id"])
    return sized.withColumn("start", F.explode(covering_starts(F.col("frame"), F.col("n"), win, hop)))


def window_table(frames: DataFrame, win: int, hop: int) -> DataFrame:
    """One row per window: id, n, start, stop."""
    lengths = series_lengths(frames).drop(ROWS)
    return (lengths.withColumn("start", F.explode(window_starts(F.col("n"), win, hop)))
            .withColumn("stop", F.least(F.col("start") + win, F.col("n"))))


def window_strength(envelope: DataFrame, win: int, hop: int, value: str = "strength") -> DataFrame:
    """Mean, population deviation and maximum of a scalar series per window.

    Frames are first reduced to blocks of gcd(win, hop). A window start is a multiple of the block, so a
    window is a run of whole blocks; the block in which the forced last window starts is cut there. With 200/10 frames
    this moves two block rows per frame instead of twenty.
    """
    _require_sizes(win, hop)
    size = math.gcd(win, hop)
    sized = attach(envelope.select("id", "frame", value), series_lengths(envelope), ["id"])
    x = F.col(value).cast("double")
    last = F.greatest(F.col("n") - win, F.lit(0)).cast("long")
    # a block is cut where the forced window starts
    forced = (last % hop != 0) & (F.col("frame") >= last)
    blocks = sized.groupBy("id", "n", F.floor(F.col("frame") / size).alias("b"), forced.alias("forced")).agg(
        F.count(x).alias("c"), F.avg(x).alias("m"), F.var_pop(x).alias("v"), F.max(x).alias("top"))
    first_frame = F.col("b") * size
    low = F.greatest(F.lit(0), F.ceil((first_frame - (win - 1)) / hop)).cast("long")
    high = F.floor(F.least(first_frame, last) / hop).cast("long")
    none = F.array().cast("array<bigint>")
    regular = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: k * hop)).otherwise(none)
    starts = F.concat(regular, F.when(F.col("forced"), F.array(last)).otherwise(none))
    rows = blocks.select("id", F.explode(starts).alias("start"), "c", "m", "v", "top")
    n, mean = F.sum("c"), F.sum(F.col("c") * F.col("m")) / F.sum("c")
    spread = F.sum(F.col("c") * (F.col("v") + F.col("m") * F.col("m"))) / n - mean * mean
    return rows.groupBy("id", "start").agg(
        n.alias("frames"), mean.alias("strength_mean"),
        F.sqrt(F.greatest(spread, F.lit(0.0))).alias("strength_std"), F.max("top").alias("strength_max"))


def time_pool(frames: DataFrame, columns: int, values: str = "values") -> DataFrame:
    """Mean of the frames in each of at most `columns` equal time buckets, long: id, n, bucket, channel, value.

    Bucket k holds frames floor(k*n/columns) to floor((k+1)*n/columns)-1; a short series stays as it is.
    """
    _require_sizes(columns)
    lengths = series_lengths(frames)
    sized = attach(frames.select("id", "frame", values), lengths, ["id"])
    frame, n = F.col("frame").cast("long"), F.col("n").cast("long")
    bucket = F.when(n <= columns, frame).otherwise(F.floor(((frame + 1) * columns - 1) / n))
    # integer check of the bucket against its edges
    guess = bucket.cast("long")
    edge = lambda k: F.floor(k * n / columns)
    exact = F.when(n <= columns, frame).when(frame < edge(guess), guess - 1).when(frame >= edge(guess + 1), guess + 1).otherwise(guess)
    cells = sized.select("id", "n", exact.alias("bucket"), F.posexplode(values).alias("channel", "x"))
    return cells.groupBy("id", "n", "bucket", "channel").agg(F.avg(F.col("x").cast("double")).alias("value"))


def gather_vectors(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Channel rows back to one array per key; the channel count bounds the array."""
    pairs = F.array_sort(F.collect_list(F.struct("channel", "value")))
    return cells.groupBy(*keys).agg(F.transform(pairs, lambda p: p["value"]).alias("values"))
