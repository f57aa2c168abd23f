import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from ostinato.operators import spectral, windows


def frames(spark, **series):
    """series name -> array channels x frames."""
    data = [(k, t, [float(v) for v in x[:, t]]) for k, x in series.items() for t in range(x.shape[1])]
    return spark.createDataFrame(data, "id string, frame long, values array<double>").repartition(3)


def starts(n, win, hop):
    """All multiples of hop that leave room for a window, and the last place that does."""
    return sorted({k for k in range(0, n, hop) if k + win <= n} | {max(0, n - win)})


@pytest.mark.parametrize("n", [1, 20, 50, 51, 75, 100, 101, 133])
def test_window_starts(spark, n):
    df = frames(spark, a=np.zeros((1, n)))
    table = windows.window_table(df, 50, 25)
    assert [r["start"] for r in table.orderBy("start").collect()] == starts(n, 50, 25)
    pairs = rows(windows.frame_windows(df, 50, 25).select("start", "frame"), "start", "frame")
    assert pairs == [(s, f) for s in starts(n, 50, 25) for f in range(s, min(s + 50, n))]


@pytest.mark.parametrize("win,hop", [(0, 1), (5, 0), (-1, 2)])
def test_sizes_must_be_positive(spark, win, hop):
    with pytest.raises(ValueError):
        windows.window_table(frames(spark, a=np.zeros((1, 4))), win, hop)


def test_gaps_in_the_index_are_refused(spark):
    df = frames(spark, a=np.zeros((1, 6))).filter("frame != 3")
    with pytest.raises(Exception, match="without gaps"):
        windows.window_table(df, 4, 2).collect()


@pytest.mark.parametrize("win,hop,n", [(20, 5, 103), (12, 8, 50), (9, 4, 7), (200, 10, 431)])
def test_window_strength(spark, small_tasks, win, hop, n):
    x = np.random.default_rng(n).random(n)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "id string, frame long, strength double")
    with small_tasks():
        got = rows(windows.window_strength(df, win, hop).select("start", "frames", "strength_mean", "strength_std", "strength_max"), "start")
    want = [(s, len(x[s:s + win]), x[s:s + win].mean(), x[s:s + win].std(), x[s:s + win].max()) for s in starts(n, win, hop)]
    assert np.allclose(got, want, atol=1e-12)


@pytest.mark.parametrize("n,columns", [(5, 8), (8, 8), (9, 8), (1000, 256), (257, 256), (47, 10)])
def test_time_pool(spark, n, columns):
    x = np.random.default_rng(n).random((2, n))
    got = rows(windows.time_pool(frames(spark, a=x), columns).select("channel", "bucket", "value"), "channel", "bucket")
    edges = [k * n // columns for k in range(columns + 1)]
    pooled = x if n <= columns else np.stack([x[:, a:b].mean(axis=1) for a, b in zip(edges, edges[1:])], axis=1)
    assert np.allclose([r[2] for r in got], pooled.ravel())


def pooled(x, win, hop, fraction):
    """Plain form of the pooled features."""
    stat = lambda w: np.concatenate((w.mean(axis=1), w.std(axis=1)))
    st = starts(x.shape[1], win, hop)
    wins = [x[:, s:s + win] for s in st]
    flux = np.array([np.maximum(np.diff(w, axis=1), 0).mean() if w.shape[1] > 1 else 0.0 for w in wins])
    k = max(1, int(np.ceil(len(wins) * fraction)))
    hard = np.array([stat(wins[i]) for i in np.argsort(flux, kind="stable")[-k:]])
    return np.concatenate((stat(x), hard.mean(axis=0), hard.max(axis=0)))


def vector(spark, x, *args):
    got = spectral.feature_vector(spectral.hard_windows(frames(spark, a=x), *args)).first()["features"]
    return np.array(got)


def test_one_hard_window(spark):
    x = np.zeros((88, 12))
    x[:, [9, 11]] = 10
    got = vector(spark, x, 4, 4, 1 / 3)
    assert len(got) == 528 == len(spectral.feature_names())
    assert np.allclose(got[176:264], 5) and np.allclose(got[264:352], 5)
    info = spectral.hard_window_diagnostics(frames(spark, a=x), 4, 4, 1 / 3).first()
    assert (info["n_frames"], info["n_windows"], info["n_hard_windows"]) == (12, 3, 1)


@pytest.mark.parametrize("n", [3, 10, 37])
def test_hard_windows_against_numpy(spark, small_tasks, n):
    x = np.round(np.random.default_rng(n).normal(size=(4, n)), 2)
    x[:, : n // 2] = 1.0  # equal scores
    with small_tasks(5):
        assert np.allclose(vector(spark, x, 6, 3, 0.4), pooled(x, 6, 3, 0.4), atol=1e-9)


def test_reversal_keeps_the_global_part_only(spark):
    x = np.tile(np.arange(20.0), (88, 1))
    forward, back = vector(spark, x, 5, 5, 0.5), vector(spark, x[:, ::-1].copy(), 5, 5, 0.5)
    assert np.allclose(forward[:176], back[:176])
    flux = lambda a: spectral.spectral_flux(frames(spark, a=a)).first()["flux"]
    assert flux(x) == 1.0 and flux(x[:, ::-1].copy()) == 0.0


def test_bad_values_are_refused(spark):
    x = np.ones((3, 4))
    x[1, 2] = np.nan
    with pytest.raises(Exception, match="finite"):
        spectral.summarize_frames(frames(spark, a=x)).collect()


@pytest.mark.parametrize("fraction", [0, 1.5])
def test_fraction_bounds(spark, fraction):
    with pytest.raises(ValueError):
        spectral.hard_windows(frames(spark, a=np.ones((2, 9))), 4, 2, fraction)
