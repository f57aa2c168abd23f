import numpy as np
import pytest

from conftest import rows
from ostinato.operators import structure
from test_windows import frames


def matrix(x, columns):
    u = x / np.maximum(np.linalg.norm(x, axis=0, keepdims=True), 1e-8)
    n = u.shape[1]
    if n > columns:
        e = [k * n // columns for k in range(columns + 1)]
        u = np.stack([u[:, a:b].mean(axis=1) for a, b in zip(e, e[1:])], axis=1)
    return u.T @ u


def curve(s, half=8):
    n = len(s)
    v = np.array([0.0] + [-s[max(0, i - half):i, i:min(n, i + half)].mean() for i in range(1, n)])
    return v - v.min()


@pytest.mark.parametrize("n,columns", [(30, 16), (23, 256), (100, 32), (2, 8)])
def test_against_numpy(spark, n, columns):
    x = np.random.default_rng(n).normal(size=(12, n))
    x[:, n // 2] = 0
    s = matrix(x, columns)
    m = len(s)
    fr = frames(spark, a=x)
    up = s[np.triu_indices(m, 1)]
    got = structure.ssm_stats(fr, columns).first()
    assert np.allclose(got[1:], (up.mean(), up.std(), (up >= .75).mean()))
    lags = np.array([np.diag(s, k).mean() if k < m else 0 for k in range(1, 65)])
    assert np.allclose([r[2] for r in rows(structure.ssm_lags(fr, columns), "lag")], lags)
    assert np.allclose(structure.ssm_lag_summary(fr, columns).first()[1:], (lags.mean(), lags.std(), lags.max()))
    v = curve(s)
    assert np.allclose([r[2] for r in rows(structure.novelty(fr, columns), "i")], v)
    pairs = rows(structure.similarity_pairs(fr, columns), "i", "j")
    assert [(i, j) for _, i, j, _ in pairs] == [(i, j) for i in range(m) for j in range(i, m)]
    spans = spark.createDataFrame([("a", 10.0)], "id string, duration double")
    peaks = sum((v[i] > v[i - 1]) and (v[i] > v[i + 1]) and v[i] > v.mean() + v.std() for i in range(1, m - 1)) if m >= 3 else 0
    got = structure.novelty_peaks(fr, spans, columns).first()
    assert got["peaks"] == peaks and got["novelty_peak_density"] == pytest.approx(peaks / 10)
    best = (-1.0, 0, 0)
    for i in range(m):
        for j in range(i + max(3, m // 10), m):
            if s[i, j] > best[0]:
                best = (s[i, j], i, j)
    got = structure.best_repeat(fr, spans, columns).first()
    assert (got["i"], got["j"]) == best[1:] and got["sim"] == pytest.approx(best[0])


def test_repeat_prefers_the_first_of_equals(spark):
    x = np.eye(4)[:, [0, 1, 2, 3, 0, 1, 2, 3, 0, 1]]
    spans = spark.createDataFrame([("a", 10.0)], "id string, duration double")
    got = structure.best_repeat(frames(spark, a=x), spans, window_seconds=2.0).first()
    assert (got["i"], got["j"], got["sim"]) == (0, 4, 1.0)
    assert (got["a_start"], got["a_end"], got["b_start"], got["b_end"]) == (0.0, 2.0, 3.0, 6.0)


def test_one_frame_is_refused(spark):
    with pytest.raises(Exception, match="two frames"):
        structure.ssm_stats(frames(spark, a=np.ones((3, 1)))).collect()
