"""Rhythm windows and lag profiles of many series at once, and the tables they rest on."""

import numpy as np
import pytest

from conftest import rows
from ostinato.operators import events, windows
from ostinato.plans import views
from test_events import envelope, profile
from test_windows import starts


def test_windows_of_many_series_share_the_work(spark, monkeypatch):
    """Windows of several lengths in one task; tasks follow the number of frames, however well they compress."""
    rng = np.random.default_rng(11)
    series = {f"s{k}": rng.random(int(n)) * (rng.random(int(n)) < .4) for k, n in enumerate(rng.integers(1, 90, 40))}
    monkeypatch.setattr(events, "FRAMES_PER_TASK", 500)
    monkeypatch.setattr(events, "VALUES_AT_ONCE", 100)
    monkeypatch.setattr(events, "HELD_VALUES", 300)
    out = events.window_tempo(envelope(spark, **series), 30, 7, 0.02, lags=20, block=16)
    assert out.rdd.getNumPartitions() == -(-sum(map(len, series.values())) // 500)
    got = {(r["id"], r["start"]): r["tempo_confidence"] for r in out.collect()}
    assert got.keys() == {(k, s) for k, x in series.items() for s in starts(len(x), 30, 7)}
    for (k, s), confidence in got.items():
        seg = series[k][s:s + 30]
        p = profile(seg, min(20, max(2, len(seg)))).mean(axis=0)
        assert confidence == pytest.approx(p.max() / (p.mean() + 1e-8))


@pytest.mark.parametrize("lags, block", [(2, 8), (12, 16), (13, 16), (70, 2048)])
def test_lag_profile_holds_a_few_blocks(spark, monkeypatch, lags, block):
    rng = np.random.default_rng(12)
    series = {f"s{k}": rng.random(int(n)) for k, n in enumerate(rng.integers(1, 200, 30))}
    monkeypatch.setattr(events, "BLOCKS_AT_ONCE", 3)
    monkeypatch.setattr(events, "FRAMES_PER_TASK", 1500)
    df = events.lag_profile(envelope(spark, **series), lags, block=block)
    plan = df._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "MapInPandas" not in plan
    got = {(r["id"], r["lag"]): (r["mean"], r["std"]) for r in df.collect()}
    for k, x in series.items():
        want = profile(x, lags)
        assert np.allclose([got[k, i] for i in range(lags)], np.array([want.mean(axis=0), want.std(axis=0)]).T, atol=1e-7)


@pytest.mark.parametrize("frames", [[0, 1, 3], [0, 1, 1], [1, 2], [0, 1, 2, 3, 8], [*range(8), *range(16, 20)], [0, None], [-1, 0]])
def test_frames_with_gaps_fail(spark, frames):
    df = spark.createDataFrame([("a", f, 1.0) for f in frames], "id string, frame long, strength double")
    for made in (lambda: events.window_tempo(df, 4, 2, 0.02, block=4), lambda: events.lag_profile(df, 4, block=4), lambda: windows.series_lengths(df)):
        with pytest.raises(Exception, match="without gaps"):
            made().collect()


def test_lengths_shuffle_words_of_frames(spark):
    df = envelope(spark, a=np.ones(200), b=np.ones(64), c=np.ones(1)).coalesce(1)
    assert rows(windows.series_lengths(df), "id") == [("a", 200, 200), ("b", 64, 64), ("c", 1, 1)]


def test_envelope_fills_the_hours_without_events(spark, small_tasks):
    on = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 2.0), ("a", 3600.0 * 5 + 1, 4.0), ("b", 0.0, None), ("c", 3600.0 * 2, 1.0), ("d", None, 1.0)],
                               "id string, t double, value double")
    want = [("a", k, {0: 3.0, 5: 4.0}.get(k, 0.0)) for k in range(6)] + [("b", 0, 0.0)] + [("c", 0, 0.0), ("c", 1, 0.0), ("c", 2, 1.0)]
    assert rows(views.envelope(on), "id", "frame") == want
    with small_tasks(1):
        assert rows(views.envelope(on), "id", "frame") == want


@pytest.mark.parametrize("win, hop", [(20, 6), (12, 4), (7, 5), (50, 10)])
def test_window_strength_cuts_the_block_of_the_last_window(spark, win, hop):
    x = np.random.default_rng(13).random(57)
    got = {r["start"]: tuple(r)[2:] for r in windows.window_strength(envelope(spark, a=x), win, hop).collect()}
    assert sorted(got) == starts(57, win, hop)
    for s, row in got.items():
        seg = x[s:s + win]
        assert np.allclose(row, (len(seg), seg.mean(), seg.std(), seg.max()))
