"""Summaries of frame vectors: channel statistics, change between frames, high-activity windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ostinato.functions.columns import is_bad_number
from ostinato.operators.blocks import BLOCK, CORE, with_halo
from ostinato.operators.ordering import positions
from ostinato.operators.skew import attach, restrict, row_count
from ostinato.operators.windows import covering_starts, frame_windows, series_lengths
from ostinato.session import settled


def channel_rows(frames: DataFrame, *keep: str, values: str = "values") -> DataFrame:
    """One row per frame and channel; a value that is no finite number fails the job."""
    x = F.col("x").cast("double")
    ok = F.when(x.isNull() | is_bad_number(x), F.raise_error(F.lit("frame values must be finite")).cast("double")).otherwise(x)
    return frames.select(*keep, F.posexplode(values).alias("channel", "x")).select(*keep, "channel", ok.alias("x"))


def summarize_frames(frames: DataFrame) -> DataFrame:
    """Mean and population deviation per series and channel."""
    return channel_rows(frames, "id").groupBy("id", "channel").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def frame_change(frames: DataFrame, values: str = "values") -> DataFrame:
    """Add `change`: mean over channels of the rise since the frame before, null for frame 0."""
    around = with_halo(frames, "frame", before=1, after=0)
    by = Window.partitionBy("id", BLOCK).orderBy("frame")
    rises = F.zip_with(values, F.lag(values).over(by),
                       lambda a, b: F.greatest(a.cast("double") - b.cast("double"), F.lit(0.0)))
    mean = F.aggregate(rises, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)
    return around.withColumn("change", mean).filter(CORE).drop(BLOCK, CORE)


def spectral_flux(frames: DataFrame) -> DataFrame:
    """Mean positive change over a whole series, 0 for a single frame."""
    return frame_change(frames).groupBy("id").agg(F.coalesce(F.avg("change"), F.lit(0.0)).alias("flux"))


def top_fraction(df: DataFrame, key: str, score: str, tie: str, fraction: float) -> DataFrame:
    """Rows of the top share of each key by score; of equal scores the larger `tie` wins."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    sizes = df.groupBy(key).agg(row_count(), F.count(F.lit(1)).alias("_size"))
    ranked = positions(df.withColumn("_down", -F.col(score)).withColumn("_late", -F.col(tie)),
                       [key], ["_down", "_late"], "_position")
    wanted = F.greatest(F.lit(1), F.ceil(F.col("_size") * F.lit(float(fraction))))
    return attach(ranked, sizes, [key]).filter(F.col("_position") < wanted).drop("_down", "_late", "_position", "_size")


def window_change(frames: DataFrame, win: int, hop: int) -> DataFrame:
    """Mean change inside each window: id, n, start, flux. A window's first frame has no change of its own."""
    changes = frame_change(frames).select("id", "frame", "change")
    sized = attach(changes, series_lengths(frames), ["id"])
    rows = sized.withColumn("start", F.explode(covering_starts(F.col("frame"), F.col("n"), win, hop)))
    inside = F.when(F.col("frame") > F.col("start"), F.col("change"))
    return rows.groupBy("id", "n", "start").agg(F.coalesce(F.avg(inside), F.lit(0.0)).alias("flux"))


def hard_windows(frames: DataFrame, win: int = 50, hop: int = 25, fraction: float = 0.2) -> DataFrame:
    """Pooled features per series, long: id, block (global, hard_mean, hard_max), stat, channel, value.

    The windows with the strongest change are pooled by mean and by maximum.
    """
    scores = window_change(frames, win, hop)
    hard = settled(top_fraction(scores, "id", "flux", "start", fraction).select("id", "start"))
    # channels are opened up for the frames of the chosen windows only
    windows = restrict(frame_windows(frames, win, hop), hard, ["id", "start"])
    channels = channel_rows(windows, "id", "start").groupBy("id", "start", "channel").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    stats = F.explode(F.array(F.struct(F.lit("mean").alias("stat"), F.col("mean").alias("x")),
                              F.struct(F.lit("std").alias("stat"), F.col("std").alias("x")))).alias("s")
    chosen = channels.select("id", "channel", stats)
    pooled = chosen.groupBy("id", "channel", F.col("s.stat").alias("stat")).agg(
        F.avg("s.x").alias("a"), F.max("s.x").alias("b"))
    pools = F.explode(F.array(F.struct(F.lit("hard_mean").alias("block"), F.col("a").alias("value")),
                              F.struct(F.lit("hard_max").alias("block"), F.col("b").alias("value")))).alias("p")
    hard_part = pooled.select("id", "channel", "stat", pools).select(
        "id", F.col("p.block").alias("block"), "stat", "channel", F.col("p.value").alias("value"))
    whole = summarize_frames(frames).select("id", "channel", stats).select(
        "id", F.lit("global").alias("block"), F.col("s.stat").alias("stat"), "channel", F.col("s.x").alias("value"))
    return whole.unionByName(hard_part)


def hard_window_diagnostics(frames: DataFrame, win: int = 50, hop: int = 25, fraction: float = 0.2) -> DataFrame:
    """Frame, window and chosen-window counts and the change scores per series."""
    scores = window_change(frames, win, hop)
    count = F.count(F.lit(1))
    return scores.groupBy("id").agg(
        F.first("n").alias("n_frames"), count.alias("n_windows"),
        F.greatest(F.lit(1), F.ceil(count * F.lit(float(fraction)))).cast("long").alias("n_hard_windows"),
        F.max("flux").alias("max_flux"), F.avg("flux").alias("mean_flux"))


def feature_names(channels: int = 88) -> list[str]:
    """Names of the pooled vector in its order."""
    base = [f"{stat}_bin_{c:02d}" for stat in ("mean", "std") for c in range(channels)]
    return [f"{block}_{name}" for block in ("global", "hard_mean", "hard_max") for name in base]


def feature_vector(long: DataFrame) -> DataFrame:
    """Long features to one array per series in the order of `feature_names`; bounded by the name list."""
    order = F.struct(F.when(F.col("block") == "global", 0).when(F.col("block") == "hard_mean", 1).otherwise(2).alias("b"),
                     F.when(F.col("stat") == "mean", 0).otherwise(1).alias("s"), F.col("channel"), F.col("value"))
    return long.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda r: r["value"]).alias("features"))
