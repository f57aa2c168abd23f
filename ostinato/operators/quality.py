"""Inventory, signal statistics, quality flags and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.functions.columns import (
    GRADES, PEAK_TARGET, hard_flags, is_bad_number, relative_error, soft_flags)


def with_grade(pieces: DataFrame, column: str = "ps") -> DataFrame:
    """Add `grade`; a label that is not one of "0".."10" fails the job and names the key."""
    known = F.col(column).isin([str(g) for g in GRADES])
    bad = F.raise_error(F.concat(F.lit("invalid grade for "), F.col("id").cast("string"))).cast("int")
    return pieces.withColumn("grade", F.when(F.coalesce(known, F.lit(False)), F.col(column).cast("int")).otherwise(bad))


def grade_or_invalid(pieces: DataFrame, column: str = "ps") -> DataFrame:
    """Add `grade` (null off the scale) and `invalid`: the report of what `with_grade` refuses, over all rows."""
    known = F.coalesce(F.col(column).isin([str(g) for g in GRADES]), F.lit(False))
    return pieces.withColumn("grade", F.when(known, F.col(column).cast("int"))).withColumn("invalid", ~known)


def inventory(meta: DataFrame, files: DataFrame) -> DataFrame:
    """Each id once with its status: matched, missing (metadata only) or orphan (file only)."""
    left = meta.select("id").distinct().withColumn("_m", F.lit(1))
    right = files.select("id").distinct().withColumn("_f", F.lit(1))
    status = F.when(F.col("_f").isNull(), "missing").when(F.col("_m").isNull(), "orphan").otherwise("matched")
    return left.join(right, "id", "full_outer").select("id", status.alias("status"))


def inventory_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(F.col("status") != "orphan").alias("n_metadata"), F.count_if(F.col("status") != "missing").alias("n_files"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("matched", "missing", "orphan")])


def key_mismatch(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Ids that only one side has: id, side."""
    rows = inventory(wanted, found).filter("status != 'matched'")
    return rows.select("id", F.when(F.col("status") == "missing", "wanted_only").otherwise("found_only").alias("side"))


def require_same_keys(wanted: DataFrame, found: DataFrame) -> None:
    bad = key_mismatch(wanted, found).groupBy("side").count().collect()
    if bad:
        raise ValueError("key sets differ: " + ", ".join(f"{r['side']}={r['count']}" for r in bad))


def waveform_stats(samples: DataFrame, clip: float = PEAK_TARGET) -> DataFrame:
    """Sample count, seconds, peak, root mean square and clipped share per series of samples(id, sr, x)."""
    size = F.abs("x")
    peak = F.max(size)
    return samples.groupBy("id").agg(
        F.count("x").alias("n_samples"), (F.count("x") / F.first("sr")).alias("duration_sec"), peak.alias("peak"),
        F.sqrt(F.avg((F.col("x") * F.col("x")).cast("double"))).alias("rms"),
        F.when(peak > 0, F.avg((size > clip).cast("double"))).otherwise(0.0).alias("clip_fraction"),
        F.bool_or(is_bad_number(F.col("x"))).alias("has_nan_inf"))


def with_empty(stats: DataFrame, pieces: DataFrame) -> DataFrame:
    """Zeros for pieces that have no samples."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return pieces.select("id").join(stats, "id", "left").select(
        "id", *[zero(c) for c in ("n_samples", "duration_sec", "peak", "rms", "clip_fraction")],
        F.coalesce("has_nan_inf", F.lit(False)).alias("has_nan_inf"))


def qc_rows(stats: DataFrame, **limits) -> DataFrame:
    """Flags of each series. stats has the columns of `waveform_stats`, meta_duration and optionally error.

    A row with an error gets the flag decode_error and null statistics instead of failing the job.
    """
    min_seconds = limits.pop("min_seconds", 3.0)
    failed = F.col("error").isNotNull() if "error" in stats.columns else F.lit(False)
    seconds, peak = F.col("duration_sec"), F.col("peak")
    hard = hard_flags(seconds, peak, F.col("has_nan_inf"), min_seconds)
    soft = soft_flags(seconds, peak, F.col("rms"), F.col("clip_fraction"), F.col("meta_duration"), **limits)
    out = stats.withColumn("flags", F.when(failed, F.array(F.lit("decode_error"))).otherwise(F.concat(hard, soft)))
    out = out.withColumn("ok", ~failed & (F.size(hard) == 0))
    out = out.withColumn("duration_rel_err", F.when(~failed, relative_error(seconds, F.col("meta_duration"))))
    for c in ("n_samples", "duration_sec", "peak", "rms", "clip_fraction"):
        out = out.withColumn(c, F.when(~failed, F.col(c)))
    return out


def qc_report(rows: DataFrame) -> DataFrame:
    """Counts of the report, long: section (total, flag), name, n."""
    totals = rows.agg(F.count(F.lit(1)).alias("n_queued"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))
    long = totals.select(F.explode(F.array(*[
        F.struct(F.lit("total").alias("section"), F.lit(c).alias("name"), F.col(c).alias("n")) for c in totals.columns])).alias("r"))
    flags = rows.select(F.explode("flags").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return long.select("r.*").unionByName(flags.select(F.lit("flag").alias("section"), "name", "n"))


def pending(jobs: DataFrame, done: DataFrame, force: DataFrame | None = None) -> DataFrame:
    """Jobs still to run: those not done, and the forced ones. A done row with null flags does not count."""
    if "flags" in done.columns:
        done = done.filter(F.col("flags").isNotNull())
    done = done.select("id").distinct()
    if force is not None:
        done = done.join(force.select("id"), "id", "left_anti")
    return jobs.join(done, "id", "left_anti")


def excerpt_bounds(pieces: DataFrame) -> DataFrame:
    """Add `bounds` (kind, start, end, length) of the excerpt, null where unknown."""
    def span(kind, a, b):
        return F.struct(F.lit(kind).alias("kind"), a.cast("double").alias("start"), b.cast("double").alias("end"),
                        (b - a).cast("double").alias("length"))
    start, end = F.col("start"), F.col("end")
    low, high, total = F.col("only_start"), F.col("only_end"), F.col("duration")
    return pieces.withColumn("bounds", F.when(start.isNotNull() & end.isNotNull(), span("start_end", start, end))
                             .when(high.isNotNull(), span("only_end", F.lit(0.0), high))
                             .when(low.isNotNull() & total.isNotNull(), span("only_start", low, total)))


def timing(pieces: DataFrame, lengths: DataFrame, audio: DataFrame, fps: float = 5.0, tolerance: float = 5.0) -> DataFrame:
    """Excerpt bounds, seconds by frames and by audio, and whether the two differ."""
    frames = lengths.select("id", (F.col("n") / F.lit(float(fps))).alias("frame_seconds"))
    seconds = audio.select("id", F.col("duration_sec").alias("audio_seconds"))
    joined = excerpt_bounds(pieces).join(frames, "id", "left").join(seconds, "id", "left")
    risk = F.coalesce(F.abs(F.col("frame_seconds") - F.col("audio_seconds")) > tolerance, F.lit(False))
    return joined.select("id", F.col("duration").alias("meta_duration"), "bounds", "frame_seconds", "audio_seconds",
                         risk.alias("align_risk"))
