"""Alignment of frame series with window series, normalization on train rows, series checks."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.columns import is_bad_number, rhythm_validity
from ostinato.operators.blocks import BLOCK, CORE, with_halo
from ostinato.operators.ordering import previous
from ostinato.operators.skew import ROWS, attach, restrict, row_count
from ostinato.operators.windows import series_lengths

SAME_TIME = 1e-9
# Channel ranges of the modes.
MODES = {"cqt": (0, 87), "rhythm": (88, 96), "both": (0, 96)}


def window_centres(windows: DataFrame, win_seconds: float | None = None) -> DataFrame:
    """Add `centre`; a window without an end needs `win_seconds` and must not be the only one."""
    middle = (F.col("t_start") + F.col("t_end")) / 2
    if win_seconds is None:
        without_end = F.raise_error(F.lit("window end or length needed")).cast("double")
    else:
        without_end = F.col("t_start") + F.lit(win_seconds / 2.0)
    return windows.withColumn("centre", F.when(F.col("t_end").isNotNull(), middle).otherwise(without_end))


def window_problems(windows: DataFrame, lengths: DataFrame, fps: float = 5.0, offset: float = 0.0, win_seconds: float | None = None) -> DataFrame:
    """Per series what keeps it from being aligned: id, n (frames), problem (null where there is none).

    The windows of a series have to be numbered 0..k-1, with starts not below zero, finite times, an end after the
    start and centres that increase; some frame has to lie between the first and the last centre. Series without
    frames or without windows are problems too.
    """
    middle = F.coalesce((F.col("t_start") + F.col("t_end")) / 2, F.col("t_start") + F.lit(None if win_seconds is None else win_seconds / 2.0).cast("double"))
    timed = windows.select("id", "win", "t_start", "t_end", middle.alias("centre"))
    ordered = previous(timed.select("id", "win", "centre"), ["id"], ["win"], {"_before": "centre"})
    falls = ordered.groupBy("id").agg(F.bool_or(F.col("centre") <= F.col("_before")).alias("_falls"))
    bad = F.col("centre").isNull() | is_bad_number(F.col("centre")) | (F.col("t_start") < 0) | F.coalesce(F.col("t_end") <= F.col("t_start"), F.lit(False))
    per_series = timed.groupBy("id", "win").agg(F.count(F.lit(1)).alias("_times"), F.bool_or(bad).alias("_bad"), F.min("centre").alias("_lo"), F.max("centre").alias("_hi"))
    per_series = per_series.groupBy("id").agg(
        F.count(F.lit(1)).alias("_k"), F.max("_times").alias("_times"), F.min("win").alias("_first"), F.max("win").alias("_last"),
        F.bool_or("_bad").alias("_bad"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    low, high = (F.col(c) + F.lit(s * SAME_TIME) for c, s in (("_lo", -1), ("_hi", 1)))
    first = F.greatest(F.lit(0.0), F.ceil((low - F.lit(float(offset))) * F.lit(float(fps))).cast("double"))
    last = F.least((F.col("n") - 1).cast("double"), F.floor((high - F.lit(float(offset))) * F.lit(float(fps))).cast("double"))
    dense = (F.col("_times") == 1) & (F.col("_first") == 0) & (F.col("_last") == F.col("_k") - 1)
    problem = (F.when(F.col("n").isNull(), "no_frames").when(F.col("_k").isNull(), "no_windows").when(~dense, "window_numbers")
               .when(F.col("_bad"), "window_times").when(F.col("_falls"), "centres_not_increasing").when(first > last, "no_coverage"))
    return lengths.join(per_series.join(falls, "id"), "id", "full_outer").select("id", "n", problem.alias("problem"))


def check_windows(windows: DataFrame, lengths: DataFrame, fps: float, offset: float, win_seconds: float | None) -> DataFrame:
    """`lengths` of the series; a series that cannot be aligned fails the job and is named."""
    found = window_problems(windows, lengths.select("id", "n"), fps, offset, win_seconds)
    refused = F.raise_error(F.concat(F.lit("cannot align "), F.col("id").cast("string"), F.lit(": "), F.col("problem"))).cast("long")
    both = found.join(lengths.select("id", ROWS), "id", "left")
    return both.select("id", F.when(F.col("problem").isNotNull(), refused).otherwise(F.col("n")).alias("n"), ROWS)


def align(frames: DataFrame, windows: DataFrame, fps: float = 5.0, offset: float = 0.0,
          win_seconds: float | None = None, validity: Callable[[Column], Column] = rhythm_validity) -> DataFrame:
    """Window values at the frame times by linear interpolation, where both neighbours are valid.

    Frame times are a regular grid, so the frames between two window centres are known by arithmetic:
    each pair of neighbouring windows is expanded to its frame numbers and joined on (id, frame). There
    is no range join, and no series is gathered in one task.

    frames(id, frame, values), windows(id, win, t_start, t_end, values) -> id, frame, t, values, valid.
    """
    if not (math.isfinite(fps) and fps > 0 and math.isfinite(offset)):
        raise ValueError("fps must be positive and finite, offset finite")
    lengths = series_lengths(frames)
    checked = check_windows(windows, lengths, fps, offset, win_seconds)
    sized = attach(window_centres(windows, win_seconds).withColumnRenamed("values", "y"),
                   checked.select("id", F.col("n").alias("_frames"), ROWS), ["id"])
    sized = sized.withColumn("ok", validity(F.col("y")))
    around = with_halo(sized, "win", before=0, after=2)
    by = Window.partitionBy("id", BLOCK).orderBy("win")
    here = F.struct("centre", "y", "ok")
    seen = around.withColumns({"a": here, "b": F.lead(here).over(by), "_third": F.lead("win", 2).over(by)}).filter(CORE)
    lone = F.col("b").isNull() & (F.col("win") == 0)
    if win_seconds is not None:
        seen = seen.withColumn("a", F.when(lone & F.col("t_end").isNull(), F.raise_error(
            F.lit("a single window needs its end")).cast(seen.schema["a"].dataType)).otherwise(F.col("a")))
    first, last = F.col("win") == 0, F.col("_third").isNull()
    pairs = seen.filter(F.col("b").isNotNull() | lone).withColumn("b", F.coalesce("b", "a")).select(
        "id", "_frames", first.alias("first"), last.alias("last"), "a", "b")
    c0, c1 = F.col("a.centre"), F.col("b.centre")
    grid = lambda c: (c - F.lit(float(offset))) * F.lit(float(fps))
    low = F.greatest(F.lit(0), F.floor(grid(c0)) - 1).cast("long")
    high = F.least(F.col("_frames") - 1, F.ceil(grid(c1)) + 1).cast("long")
    placed = pairs.filter(low <= high).withColumn("frame", F.explode(F.sequence(low, high)))
    time = F.col("frame") / F.lit(float(fps)) + F.lit(float(offset))
    inside = ((F.col("t") > c0) | (F.col("first") & (F.col("t") >= c0 - SAME_TIME))) & (
        (F.col("t") <= c1) | (F.col("last") & (F.col("t") <= c1 + SAME_TIME)))
    placed = placed.withColumn("t", time).filter(inside)
    target = F.least(F.greatest(F.col("t"), c0), c1)
    at_left = F.abs(target - c0) <= SAME_TIME
    at_right = F.abs(target - c1) <= SAME_TIME
    between = F.zip_with("a.y", "b.y", lambda p, q: (q - p) / (c1 - c0) * (target - c0) + p)
    value = F.when(at_left, F.col("a.y")).when(at_right, F.col("b.y")).otherwise(between)
    valid = F.when(at_left, F.col("a.ok")).when(at_right, F.col("b.ok")).otherwise(
        F.zip_with("a.ok", "b.ok", lambda p, q: p & q))
    windowed = placed.select("id", "frame", "t", value.alias("_y"), valid.alias("_ok"))
    windowed = windowed.withColumn("_y", F.zip_with("_y", "_ok", lambda v, ok: F.when(ok, v).otherwise(0.0)))
    joined = frames.select("id", F.col("frame").cast("long").alias("frame"), "values").join(windowed, ["id", "frame"])
    base = F.transform("values", lambda x: x.cast("double"))
    return joined.select("id", "frame", "t", F.concat(base, F.col("_y")).alias("values"),
                         F.concat(F.transform("values", lambda x: F.lit(True)), F.col("_ok")).alias("valid"))


def select_channels(df: DataFrame, mode: str) -> DataFrame:
    """Channels of a mode from aligned arrays."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    low, high = MODES[mode]
    cut = lambda c: F.slice(c, low + 1, high - low + 1)
    return df.withColumn("values", cut("values")).withColumn("valid", cut("valid"))


def channel_range(long: DataFrame, low: int, high: int) -> DataFrame:
    """Channel filter on the long form; reaches the scan where the channel is stored."""
    return long.filter(F.col("channel").between(low, high))


def channel_stats(df: DataFrame, train: DataFrame, strict: bool = False, floor: str = "unit") -> DataFrame:
    """Mean, deviation and count per channel over the valid cells of the train series.

    floor "unit": a deviation below 1e-8 becomes 1. floor "variance": variance is at least 1e-8.
    strict: a channel without a valid cell is an error, otherwise it gets mean 0 and deviation 1.
    """
    rows = restrict(df, train, ["id"])
    if rows.isEmpty():
        raise ValueError("empty train set")
    cells = rows.select(F.posexplode(F.arrays_zip(F.col("values").alias("x"), F.col("valid").alias("ok"))).alias("channel", "c"))
    x = F.when(F.col("c.ok"), F.col("c.x").cast("double"))
    out = cells.groupBy("channel").agg(F.avg(x).alias("m"), F.var_pop(x).alias("v"), F.count(x).alias("n_valid"))
    empty = F.col("n_valid") == 0
    if floor == "variance":
        std = F.sqrt(F.greatest(F.col("v"), F.lit(1e-8)))
    else:
        std = F.when(F.sqrt("v") < 1e-8, 1.0).otherwise(F.sqrt("v"))
    nothing = F.raise_error(F.lit("a channel has no valid cell")).cast("double") if strict else F.lit(0.0)
    return out.select("channel", F.when(empty, nothing).otherwise(F.col("m")).alias("mean"),
                      F.when(empty, 1.0).otherwise(std).alias("std"), "n_valid")


def standardize(df: DataFrame, norm: DataFrame) -> DataFrame:
    """(x - mean) / std in single precision; invalid cells become 0.

    The norm is one row per channel. It enters as one array value, so the series are not exploded,
    joined or shuffled.
    """
    packed = norm.agg(F.array_sort(F.collect_list(F.struct(
        "channel", F.col("mean").cast("float").alias("m"), F.col("std").cast("float").alias("s")))).alias("p"))
    with_norm = df.withColumn("_p", packed.scalar())
    z = F.transform("values", lambda x, i: ((x.cast("float") - F.get("_p", i)["m"]) / F.get("_p", i)["s"]).cast("float"))
    kept = F.zip_with(z, "valid", lambda v, ok: F.when(~ok, F.lit(0.0).cast("float")).when(
        v.isNull() | is_bad_number(v), F.raise_error(F.lit("standardized values must be finite")).cast("float")).otherwise(v))
    return with_norm.withColumn("values", kept).drop("_p")


def peak_normalize(samples: DataFrame, value: str = "x", target: float = 0.99) -> DataFrame:
    """Scale each series to a peak of `target`; a silent series stays as it is."""
    peaks = samples.groupBy("id").agg(F.max(F.abs(value)).alias("_peak"), row_count())
    scaled = F.when(F.col("_peak") > 0, F.col(value) * (F.lit(float(target)) / F.col("_peak"))).otherwise(F.col(value))
    return attach(samples, peaks, ["id"]).withColumn(value, scaled).drop("_peak")


def check_series(windows: DataFrame) -> DataFrame:
    """Problems of a window series: bad times, values or order."""
    seen = previous(windows, ["id"], ["win"], {"_before": "t_start"})
    problem = (F.when(F.col("t_start").isNull() | is_bad_number(F.col("t_start")) | (F.col("t_start") < 0), "bad_start")
               .when(F.col("t_end") <= F.col("t_start"), "end_before_start")
               .when(F.col("t_start") <= F.col("_before"), "not_increasing")
               .when(F.exists("values", lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))), "bad_value"))
    return seen.select("id", "win", problem.alias("problem")).filter("problem is not null")


def nonmonotonic(df: DataFrame, index: str, time: str) -> DataFrame:
    """Rows whose time does not increase over the row before it by index."""
    seen = previous(df, ["id"], [index], {"t_before": time})
    return seen.filter(F.col(time) <= F.col("t_before"))
