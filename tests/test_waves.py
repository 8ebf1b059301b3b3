"""Waveform and decomposition operators against analytic truth."""

from __future__ import annotations

import numpy as np
import pytest

from lagmill.functions import kernels as K
from lagmill.operators import decomposition, waves


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "series_id int, values array<double>")


def test_dominant_frequency_and_spectrogram(spark):
    t = np.arange(256)
    x = np.stack([np.sin(2 * np.pi * f * t) for f in (0.1, 0.23)])
    got = {r.series_id: r for r in waves.dominant_frequency(frame(spark, x), 1.0, 0.05, 0.4).collect()}
    assert [got[0].frequency, got[1].frequency] == pytest.approx([0.1, 0.23], abs=0.002)
    rows = waves.spectrogram(frame(spark, x), 64, 32).collect()
    assert len(rows) == 14 and all(abs(np.argmax(r.magnitudes) / 64 - (0.1, 0.23)[r.series_id]) < 0.02 for r in rows)


def test_quality_windows(spark):
    g = np.random.default_rng(0)
    x = np.stack([np.sin(np.arange(300) / 3), g.normal(size=300)])
    a, b = waves.quality(frame(spark, x), 1.0, 100).orderBy("series_id").collect()
    assert a.n == b.n == 5 and a.flatness_mean < b.flatness_mean and a.crossings_mean < b.crossings_mean
    assert b.kurt_mean == pytest.approx(3, abs=1) and a.kurt_mean == pytest.approx(1.5, abs=0.1)


def test_kalman_smoothing_reduces_noise(spark):
    g = np.random.default_rng(1)
    level = np.cumsum(0.1 * g.normal(size=(3, 400)), axis=1)
    rows = waves.kalman_smooth(frame(spark, level + g.normal(size=level.shape)), 0.01, 1.0).orderBy("series_id").collect()
    assert all(np.mean((np.array(r["values"]) - level[r.series_id]) ** 2) < 0.2 for r in rows)


def test_prewhitening_removes_an_autoregression():
    g = np.random.default_rng(2)
    e = g.normal(size=(2, 4000))
    x = np.zeros_like(e)
    for t in range(2, 4000):
        x[:, t] = 0.6 * x[:, t - 1] - 0.3 * x[:, t - 2] + e[:, t]
    y = waves.prewhiten(2)(x)
    assert abs(np.corrcoef(y[0, 1:], y[0, :-1])[0, 1]) < 0.05 and np.corrcoef(y[1], e[1])[0, 1] > 0.99


def test_deconvolution_and_cepstrum():
    g = np.random.default_rng(3)
    x, h = g.normal(size=(1, 128)), np.zeros((1, 128))
    h[0, :4] = 1, 0.5, 0.25, 0.1
    y = np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(h), 128)
    assert waves.deconvolve(1e-3)(y, h) == pytest.approx(x, abs=1e-3)
    pulse = 0.8 ** np.arange(256.0)[None]
    assert waves.cepstral_delay(pulse, np.roll(pulse, 9, axis=1) * 0.5)[0] == 9


def test_splines():
    old, new = np.arange(12.0), np.linspace(0, 11, 57)
    x = np.stack([old**3 - 4 * old**2 + 1, 2 * old])
    assert K.resampled(old, new)(x) == pytest.approx(np.stack([new**3 - 4 * new**2 + 1, 2 * new]))
    assert K.resampled(old, old)(np.sin(x)) == pytest.approx(np.sin(x))


def test_decomposition(spark):
    g = np.random.default_rng(4)
    t = np.arange(80)
    sources = np.stack([np.sign(np.sin(t / 3)), np.sin(t / 7.3)])
    x = g.normal(size=(200, 2)) @ sources + 0.01 * g.normal(size=(200, 80))
    components, values, share = decomposition.principal_timecourses(frame(spark, x), 80, 4)
    want = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert values == pytest.approx(want[1][:4] ** 2 / 200) and share[:2].sum() > 0.99
    assert np.abs((components * want[2][:4]).sum(axis=1)) == pytest.approx(1)
    assert decomposition.acceleration_factor(values) == 2 and decomposition.optimal_coordinates(np.array([9.0, 3.0, 1.0, 0.95, 0.8])) == 2
    found = decomposition.independent_rotation(components[:2])
    match = np.abs(np.corrcoef(np.vstack([found, sources]))[:2, 2:])
    assert match.max(axis=0) == pytest.approx(1, abs=0.05)
    got = decomposition.loadings(frame(spark, x[:3]), components).orderBy("series_id").collect()
    assert np.array([r.loadings for r in got]) == pytest.approx(x[:3] @ components.T)
