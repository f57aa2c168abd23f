"""Column expressions shared by the operators; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label scale, the quality thresholds and their flag names.
GRADES = list(range(11))
MIN_SECONDS = 3.0
LONG_SECONDS = 600.0
DURATION_TOLERANCE = 0.10
LOW_RMS = 1e-4
CLIP_FRACTION = 1e-3
PEAK_TARGET = 0.99


def grade_band(grade: Column) -> Column:
    """Three label bands."""
    return F.when(grade <= 3, "Low0-3").when(grade <= 6, "Mid4-6").otherwise("High7-10")


def rounded_grade(score: Column) -> Column:
    """Nearest grade on the scale, halves upwards."""
    return F.floor(F.least(F.greatest(score, F.lit(0.0)), F.lit(10.0)) + 0.5)


def is_bad_number(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def relative_error(actual: Column, expected: Column) -> Column:
    """|actual - expected| / expected; null where there is nothing to compare with."""
    return F.when(expected > 0, F.abs(actual - expected) / expected)


def numeric_or_null(text: Column) -> Column:
    """A JSON scalar kept as text, as a number; true, false and words are not numbers."""
    return text.try_cast("double")


def hard_flags(seconds: Column, peak: Column, bad: Column, min_seconds: float = MIN_SECONDS) -> Column:
    return F.array_compact(F.array(
        F.when(bad, F.lit("non_finite")),
        F.when(seconds < min_seconds, F.lit("too_short")),
        F.when(peak == 0, F.lit("silence"))))


def soft_flags(seconds: Column, peak: Column, rms: Column, clip_fraction: Column, expected: Column, *,
               tolerance: float = DURATION_TOLERANCE, low_rms: float = LOW_RMS,
               clipping: float = CLIP_FRACTION, long_seconds: float = LONG_SECONDS) -> Column:
    known = F.coalesce(expected > 0, F.lit(False))
    return F.array_compact(F.array(
        F.when(~known, F.lit("missing_meta_duration"))
        .when(relative_error(seconds, expected) > tolerance, F.lit("duration_mismatch")),
        F.when((peak > 0) & (rms < low_rms), F.lit("low_rms")),
        F.when(clip_fraction > clipping, F.lit("clipping")),
        F.when(seconds > long_seconds, F.lit("long_duration"))))


def recording_id(url: Column) -> Column:
    """Eleven-character video id of the known hosts, else null."""
    text = F.trim(url)
    # by patterns, not by a strict parser: links with illegal characters or blank parameters still have an id
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.split(F.regexp_replace(F.regexp_extract(text, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "^/+|/+$", ""), "/")
    query = F.url_decode(F.regexp_replace(F.regexp_extract(F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1), r"(?:^|&)v=([^&]+)", 1), "%(?![0-9A-Fa-f]{2})", "%25"))
    from_path = F.when(F.get(path, F.lit(0)).isin("embed", "shorts", "v"), F.get(path, F.lit(1)))
    long_form = F.coalesce(F.when(F.length(query) > 0, query), from_path)
    is_long = (host == "youtube.com") | host.endswith(".youtube.com") | (host == "youtube-nocookie.com")
    value = F.when(host.isin("youtu.be", "www.youtu.be"), F.get(path, F.lit(0))).when(is_long, long_form)
    return F.when(value.rlike("^[A-Za-z0-9_-]{11}\\z"), value)


def vector_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def unit_vector(v: Column, floor: float = 1e-8) -> Column:
    norm = F.greatest(vector_norm(v), F.lit(floor))
    return F.transform(v, lambda x: x / norm)


def is_close(a: Column, b: Column, rtol: float = 1e-6, atol: float = 1e-7) -> Column:
    """Both null, or numbers within the tolerance."""
    near = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return F.when(a.isNull() & b.isNull(), True).otherwise(F.coalesce(near, F.lit(False)))


def reduced_length(length: Column) -> Column:
    """Sequence length after two stride-2 layers."""
    return F.floor((F.floor((length + 1) / 2) + 1) / 2).cast("long")


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]+", "_")


def same_text_hash(content: Column, expected: Column) -> Column:
    """True where the digest matches the text as it is, with LF or with CRLF line ends."""
    lf = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    crlf = F.replace(lf, F.lit("\n"), F.lit("\r\n"))
    return expected.isin(F.sha2(content, 256), F.sha2(lf, 256), F.sha2(crlf, 256))


def rhythm_validity(values: Column) -> Column:
    """Which of the nine window channels hold an observation."""
    density, strength, ioi = F.get(values, F.lit(0)), F.get(values, F.lit(1)), F.get(values, F.lit(4))
    has_ioi = ioi > 0
    active = (density > 0) & (strength > 0)
    yes = F.lit(True)
    return F.array(yes, yes, yes, yes, has_ioi, has_ioi, has_ioi, active & has_ioi, active)
