import pytest
from pyspark.sql import functions as F

from conftest import rows
from ostinato.functions import columns as fc
from ostinato.operators import quality

STATS = ("id string, n_samples long, duration_sec double, peak double, rms double, clip_fraction double, "
         "has_nan_inf boolean, meta_duration double, error string")


def flags(spark, seconds, peak, rms, clip=0.0, bad=False, meta=None, error=None):
    df = spark.createDataFrame([("a", 1, float(seconds), float(peak), float(rms), clip, bad, meta, error)], STATS)
    r = quality.qc_rows(df).first()
    return r["flags"], r["ok"], r


@pytest.mark.parametrize("args,want,ok", [
    (dict(seconds=1, peak=1, rms=1, meta=1.0), ["too_short"], False),
    (dict(seconds=5, peak=0, rms=0, meta=5.0), ["silence"], False),
    (dict(seconds=5, peak=.5, rms=.5), ["missing_meta_duration"], True),
    (dict(seconds=5, peak=.5, rms=.5, meta=0.0), ["missing_meta_duration"], True),
    (dict(seconds=5, peak=.5, rms=.5, meta=10.0), ["duration_mismatch"], True),
    (dict(seconds=601, peak=.1, rms=.1, meta=601.0), ["long_duration"], True),
    (dict(seconds=5, peak=1, rms=1e-5, clip=.5, bad=True, meta=5.0), ["non_finite", "low_rms", "clipping"], False),
    (dict(seconds=110, peak=.1, rms=.1, meta=100.0), [], True),
])
def test_flags(spark, args, want, ok):
    assert flags(spark, **args)[:2] == (want, ok)


def test_decode_failure_is_a_row(spark):
    got = flags(spark, 5, 1, 1, meta=5.0, error="broken")
    assert got[:2] == (["decode_error"], False) and got[2]["peak"] is None and got[2]["duration_sec"] is None


def test_waveform_stats(spark):
    df = spark.createDataFrame([("a", 2, x) for x in (.5, -1.0, 0.0, 0.5)] + [("n", 2, float("nan")), ("z", 2, 0.0)], "id string, sr int, x float")
    got = {r["id"]: r for r in quality.waveform_stats(df).collect()}
    assert got["a"]["duration_sec"] == 2 and got["a"]["peak"] == 1 and got["a"]["clip_fraction"] == .25
    assert got["a"]["rms"] == pytest.approx((1.5 / 4) ** .5) and got["n"]["has_nan_inf"] and got["z"]["clip_fraction"] == 0
    empty = quality.with_empty(quality.waveform_stats(df), spark.createDataFrame([("q",)], "id string")).first()
    assert tuple(empty) == ("q", 0, 0.0, 0.0, 0.0, 0.0, False)


def test_report_and_inventory(spark):
    df = spark.createDataFrame([("a", 1, 5.0, .5, .5, 0.0, False, 5.0, None), ("b", 1, 5.0, 0.0, 0.0, 0.0, False, None, None)], STATS)
    got = {(r["section"], r["name"]): r["n"] for r in quality.qc_report(quality.qc_rows(df)).collect()}
    assert got == {("total", "n_queued"): 2, ("total", "n_ok"): 1, ("total", "n_failed"): 1, ("flag", "silence"): 1, ("flag", "missing_meta_duration"): 1}
    meta = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    files = spark.createDataFrame([("a",), ("b",), ("o",)], "id string")
    inv = quality.inventory(meta, files)
    assert rows(inv, "id") == [("a", "matched"), ("b", "matched"), ("c", "missing"), ("o", "orphan")]
    assert quality.inventory_counts(inv).first().asDict() == dict(n_metadata=3, n_files=3, matched=2, missing=1, orphan=1)
    with pytest.raises(ValueError, match="differ"):
        quality.require_same_keys(meta, files)
    quality.require_same_keys(meta, meta)


def test_pending(spark):
    jobs = spark.createDataFrame([(i,) for i in "abcd"], "id string")
    done = spark.createDataFrame([("a", ["x"]), ("b", None), ("c", [])], "id string, flags array<string>")
    force = spark.createDataFrame([("c",)], "id string")
    assert sorted(r["id"] for r in quality.pending(jobs, done, force).collect()) == ["b", "c", "d"]


def test_grade_parse(spark):
    good = spark.createDataFrame([("a", "0"), ("b", "10")], "id string, ps string")
    assert [r["grade"] for r in quality.with_grade(good).orderBy("id").collect()] == [0, 10]
    for bad in ("11", "1.0", "x", None, " 1"):
        with pytest.raises(Exception, match="invalid grade for k"):
            quality.with_grade(spark.createDataFrame([("k", bad)], "id string, ps string")).collect()


@pytest.mark.parametrize("url,want", [
    ("https://youtu.be/abcdefghijk", "abcdefghijk"), ("https://www.youtu.be/abcdefghijk?t=3", "abcdefghijk"),
    ("https://www.youtube.com/watch?v=abcdefghijk&x=1", "abcdefghijk"), ("https://m.youtube.com/embed/abc_efg-ijk", "abc_efg-ijk"),
    ("https://youtube.com/shorts/abcdefghijk/", "abcdefghijk"), ("https://YOUTUBE.com/v/abcdefghijk", "abcdefghijk"),
    ("https://youtube-nocookie.com/embed/abcdefghijk", "abcdefghijk"), ("https://www.youtube-nocookie.com/embed/abcdefghijk", None),
    ("https://notyoutube.com/watch?v=abcdefghijk", None), ("https://youtu.be/short", None), ("https://youtu.be/abcdefghijkl", None),
    ("https://youtube.com/other/abcdefghijk", None), ("", None), (None, None), ("not a url", None)])
def test_recording_id(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(fc.recording_id(F.col("u")).alias("r")).first()["r"] == want


def test_composer_key(spark, small_tasks):
    from ostinato.functions.text import composer_key
    df = spark.createDataFrame([("1", " Straße  X "), ("2", "STRASSE x"), ("3", "Ａ")], "id string, composer string")
    with small_tasks(1):
        assert {r["id"]: r["composer_key"] for r in composer_key(df).collect()} == {"1": "strasse x", "2": "strasse x", "3": "a"}


def test_small_expressions(spark):
    df = spark.createDataFrame([(54, 101)], "a long, b long")
    assert tuple(df.select(fc.reduced_length(F.col("a")), fc.reduced_length(F.col("b"))).first()) == (14, 26)
    t = spark.createDataFrame([("a\r\nb",)], "t string")
    for form in ("a\r\nb", "a\nb"):
        assert t.select(fc.same_text_hash(F.col("t"), F.sha2(F.lit(form), 256))).first()[0]
    assert not t.select(fc.same_text_hash(F.col("t"), F.sha2(F.lit("a\nc"), 256))).first()[0]
    assert spark.range(1).select(fc.slug(F.lit("a.b--c"))).first()[0] == "a_b_c"
    v = F.array(*[F.lit(float(x)) for x in (1, 1, 0, 0, 0, 0, 0, 90, 2)])
    assert spark.range(1).select(fc.rhythm_validity(v)).first()[0] == [True] * 4 + [False] * 4 + [True]


def test_timing(spark):
    cols = "id string, duration double, start double, `end` double, only_start double, only_end double"
    df = spark.createDataFrame([("a", 100.0, 1.0, 5.0, None, None), ("b", 100.0, None, None, None, 9.0), ("c", 100.0, 2.0, None, 30.0, None),
                                ("d", None, None, None, 30.0, None)], cols)
    n = spark.createDataFrame([("a", 20), ("b", 100)], "id string, n long")
    audio = spark.createDataFrame([("a", 5.0), ("b", 30.0)], "id string, duration_sec double")
    got = {r["id"]: r for r in quality.timing(df, n, audio).collect()}
    assert tuple(got["a"]["bounds"]) == ("start_end", 1.0, 5.0, 4.0) and not got["a"]["align_risk"]
    assert tuple(got["b"]["bounds"]) == ("only_end", 0.0, 9.0, 9.0) and got["b"]["align_risk"]
    assert tuple(got["c"]["bounds"]) == ("only_start", 30.0, 100.0, 70.0) and got["d"]["bounds"] is None
