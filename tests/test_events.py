import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from ostinato.operators import events
from test_windows import starts


def onsets(spark, **series):
    return spark.createDataFrame([(k, float(t)) for k, ts in series.items() for t in ts], "id string, t double").repartition(3)


def envelope(spark, **series):
    return spark.createDataFrame([(k, i, float(v)) for k, xs in series.items() for i, v in enumerate(xs)],
                                 "id string, frame long, strength double").repartition(3)


@pytest.mark.parametrize("limit", [20, 10_000])
def test_ioi_stats(spark, small_tasks, limit):
    times = np.sort(np.random.default_rng(1).random(150) * 90)
    with small_tasks(limit):
        got = {r["id"]: tuple(r)[1:] for r in events.ioi_stats(onsets(spark, a=times, one=[3.0], b=[1, 2, 4])).collect()}
    d = np.diff(times)
    assert np.allclose(got["a"], (d.mean(), d.std(), d.std() / d.mean(), *np.percentile(d, (25, 50, 75))))
    assert got["one"] == (0.0,) * 6
    assert np.allclose(got["b"], (1.5, .5, 1 / 3, 1.25, 1.5, 1.75))


@pytest.mark.parametrize("limit", [20, 10_000])
def test_strength_stats(spark, small_tasks, limit):
    x = np.random.default_rng(2).random(101)
    with small_tasks(limit):
        got = tuple(events.strength_stats(envelope(spark, a=x)).first())[1:]
    assert np.allclose(got, (x.mean(), x.std(), x.max(), *np.percentile(x, (25, 50, 75, 95))))


def test_density(spark):
    df = onsets(spark, a=[0, .5, 1, 7.9, 8.0])
    lengths = spark.createDataFrame([("a", 8.0), ("quiet", 4.0), ("void", 0.0)], "id string, duration double")
    got = {r["id"]: r for r in events.event_density(df, lengths).collect()}
    bins = [got["a"][f"bin_{i}"] for i in range(8)]
    assert bins == [2, 1, 0, 0, 0, 0, 0, 1] and got["a"]["density"] == 5 / 8
    assert got["a"]["bin_std"] == pytest.approx(np.std(bins)) and got["a"]["bin_max"] == 2
    assert got["quiet"]["density"] == 0 and got["void"]["bin_std"] == 0


@pytest.mark.parametrize("block", [7, 4096])
def test_lag_autocorr(spark, block):
    x = np.random.default_rng(3).random(60)
    got = [r[2] for r in rows(events.lag_autocorr(envelope(spark, a=x), 10, block=block), "lag")]
    assert np.allclose(got, [x[: 60 - k] @ x[k:] for k in range(10)])


def profile(x, win):
    """Local autocorrelation frame by frame, by sums instead of a transform."""
    half = win // 2
    ramp = lambda edge: np.linspace(0, edge, half, endpoint=False)
    padded = np.concatenate((ramp(x[0]), x, ramp(x[-1])[::-1]))
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win) / win)
    out = []
    for i in range(len(x)):
        f = padded[i:i + win] * hann
        r = np.array([f[: win - k] @ f[k:] for k in range(win)])
        out.append(r / abs(r).max() if abs(r).max() > 0 else r)
    return np.array(out)


@pytest.mark.parametrize("block", [16, 2048])
def test_lag_profile(spark, block):
    x = np.abs(np.sin(np.arange(70) * .7)) + np.random.default_rng(4).random(70) * .1
    got = np.array([r[2:] for r in rows(events.lag_profile(envelope(spark, a=x), 12, block=block), "lag")])
    want = profile(x, 12)
    assert np.allclose(got[:, 0], want.mean(axis=0)) and np.allclose(got[:, 1], want.std(axis=0), atol=1e-7)


def test_tempo_finds_the_beat(spark):
    x = (np.arange(600) % 25 == 0).astype(float)  # 0.5 s at 0.02 s per frame
    df = envelope(spark, a=x)
    got = events.tempo(events.lag_profile(df, 192), 0.02).first()
    assert got["tempo_bpm"] == pytest.approx(120) and got["tempo_confidence"] > 2
    windows = events.window_tempo(df, 200, 10, 0.02)
    assert {r["start"] for r in windows.collect()} == set(starts(600, 200, 10))
    assert windows.filter("abs(tempo_bpm - 120) > 1").count() == 0


@pytest.mark.parametrize("block", [64, 1024])
def test_window_tempo_does_not_depend_on_blocks(spark, block):
    x = np.random.default_rng(5).random(173)
    got = rows(events.window_tempo(envelope(spark, a=x), 30, 7, 0.02, lags=20, block=block).drop("id"), "start")
    assert [r[0] for r in got] == starts(173, 30, 7)
    want = [profile(x[s:s + 30], 20).mean(axis=0) for s in starts(173, 30, 7)]
    assert np.allclose([r[2] for r in got], [p.max() / (p.mean() + 1e-8) for p in want])


def test_event_windows(spark, small_tasks):
    rng = np.random.default_rng(6)
    x, times = rng.random(57), np.sort(rng.choice(np.arange(0, 57, .25), 60, replace=False))
    with small_tasks():
        out = events.event_windows(onsets(spark, a=times), envelope(spark, a=x, quiet=np.zeros(9)), 20, 6, 1.0)
        got = {(r["id"], r["start"]): r for r in out.collect()}
    assert {s for k, s in got if k == "a"} == set(starts(57, 20, 6)) and ("quiet", 0) in got
    for s in starts(57, 20, 6):
        inside = times[(times >= s) & (times < s + 20)]
        d = np.diff(inside)
        r = got[("a", s)]
        assert r["onset_density"] == pytest.approx(len(inside) / 20)
        assert np.allclose((r["ioi_mean"], r["ioi_std"], r["ioi_cv"]), (d.mean(), d.std(), d.std() / d.mean()))
        seg = x[s:s + 20]
        assert np.allclose((r["onset_strength_mean"], r["onset_strength_std"], r["onset_strength_max"]), (seg.mean(), seg.std(), seg.max()))
    quiet = got[("quiet", 0)]
    assert quiet["t_end"] == 9 and quiet["onset_density"] == quiet["ioi_mean"] == 0


def test_rhythm_row_has_nine_channels(spark):
    out = events.event_windows(onsets(spark, a=[1, 3, 5]), envelope(spark, a=np.arange(10.)), 4, 2, 1.0, with_tempo=True)
    assert len(out.select(events.window_values(out).alias("v")).first()["v"]) == 9


def test_local_peaks(spark):
    x = np.random.default_rng(7).integers(0, 6, 120).astype(float)
    got = [r["frame"] for r in events.local_peaks(envelope(spark, a=x), 3, 2, 4, 4, 0.5).orderBy("frame").collect()]
    want = [i for i in range(120) if all(x[i] > v for v in x[max(0, i - 3):i]) and all(x[i] >= v for v in x[i + 1:i + 3])
            and x[i] >= x[max(0, i - 4):i + 5].mean() + 0.5]
    assert got == want and min(np.diff(got)) > 2


def spaced_by_hand(peaks, gap):
    kept = []
    for frame, value in sorted(peaks, key=lambda p: (-p[1], p[0])):
        if all(abs(frame - other) > gap for other, _ in kept):
            kept.append((frame, value))
    return sorted(kept)


@pytest.mark.parametrize("gap, block", [(0, 8), (3, 8), (9, 4), (5, 4096)])
def test_spaced_peaks(spark, gap, block):
    rng = random.Random(gap)
    series = {"ramp": [(i, float(i)) for i in range(60)], "fall": [(i, 100.0 - i) for i in range(0, 90, 2)], "flat": [(i, 1.0) for i in range(40)],
              "any": [(i, round(rng.random(), 1)) for i in range(200) if rng.random() < .6], "one": [(7, 0.5)]}
    df = spark.createDataFrame([(k, *p) for k, peaks in series.items() for p in peaks], "id string, frame long, strength double").repartition(4)
    got = rows(events.spaced_peaks(df, gap, block=block), "id", "frame")
    assert got == sorted((k, *p) for k, peaks in series.items() for p in spaced_by_hand(peaks, gap))
    assert events.spaced_peaks(df.filter("false"), gap).count() == 0
    with pytest.raises(ValueError):
        events.spaced_peaks(df, -1)
