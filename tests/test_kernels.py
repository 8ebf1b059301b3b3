"""Numpy kernels against analytic truth and brute force."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lagmill.functions import kernels as K


def sines(n=400, f=0.05, phases=(0.0, 1.0)):
    t = np.arange(n)
    return np.stack([np.sin(2 * np.pi * f * t + p) for p in phases])


@pytest.mark.parametrize("kind", ["brickwall", "trapezoidal", "gaussian", "butterworth"])
def test_band_filter_passes_its_band_only(kind):
    slow, fast = sines(f=0.05), sines(f=0.4)
    f = K.band_filter(1.0, "lfo", kind)
    mid = slice(60, 340)
    if kind != "gaussian":
        assert np.abs(f(slow) - slow)[:, mid].max() < 0.1
    assert np.abs(f(fast))[:, mid].max() < 0.1 and np.abs(f(slow + 7) - f(slow))[:, mid].max() < 0.1
    assert K.band_filter(1.0, "lfo", kind, stop=True)(slow) == pytest.approx(slow - f(slow))
    with pytest.raises(ValueError, match="Nyquist"):
        K.band_filter(1.0, "cardiac")


def test_detrend_removes_polynomials_only():
    t = np.linspace(0, 1, 50)
    assert np.abs(K.poly_detrend(3)(np.stack([1 + t + t**2 - t**3, t * 0]))).max() < 1e-9
    wave = sines(50, 0.2)
    assert K.poly_detrend(2)(K.poly_detrend(2)(wave)) == pytest.approx(K.poly_detrend(2)(wave))


def test_savgol_keeps_polynomials_of_its_order():
    t = np.arange(40.0)
    x = np.stack([t**2 - 3 * t, 2 + t])
    assert K.savgol(9, 2)(x) == pytest.approx(x)


def test_shift_and_alignment():
    x = sines(401, 0.03)
    moved = K.shifted(x, np.array([5.0, -2.5]))
    assert moved[0, 60:340] == pytest.approx(x[0, 55:335], abs=0.02)
    assert moved[1, 60:340] == pytest.approx(np.sin(2 * np.pi * 0.03 * (np.arange(60, 340) + 2.5) + 1), abs=0.02)


def test_phase_and_envelope():
    x = 3 * sines(400, 0.05, (0.0,))
    assert K.envelope(x)[0, 50:350] == pytest.approx(3, abs=0.05)
    assert np.diff(K.phase(x)[0, 50:350]) == pytest.approx(2 * np.pi * 0.05, abs=0.01)


@pytest.mark.parametrize("n", [200, 201])
@pytest.mark.parametrize("weighting", ["None", "phat", "liang", "eckart", "regressor"])
def test_correlation_finds_known_lags(n, weighting):
    g = np.random.default_rng(1)
    base = g.normal(size=n + 40)
    for lag in (-7, 0, 4):
        a, b = base[20 - lag : 20 - lag + n], base[20 : 20 + n]  # a comes after b by lag
        c = K.generalized_correlation(10, weighting)(a[None], b[None])
        assert c[0].argmax() - 10 == lag
    c, d = (K.generalized_correlation(10, weighting)(x[None], y[None])[0] for x, y in ((a, b), (b, a)))
    if weighting != "regressor":
        assert c == pytest.approx(d[::-1])


def test_plain_correlation_is_the_sum_of_products():
    g = np.random.default_rng(2)
    a, b = g.normal(size=(2, 1, 30))
    c = K.generalized_correlation(5, "None")(a, b)[0]
    want = [sum(a[0, t] * b[0, t - k] for t in range(30) if 0 <= t - k < 30) for k in range(-5, 6)]
    assert c == pytest.approx(want)


def test_coherence_of_a_shared_frequency():
    g = np.random.default_rng(3)
    t = np.arange(4096)
    common = np.sin(2 * np.pi * t / 8)
    a, b = (common + 0.5 * g.normal(size=len(t)) for _ in range(2))
    c = K.coherence(64)(a[None], b[None])[0]
    assert c[8] > 0.9 and np.median(np.delete(c, [7, 8, 9])) < 0.2


def test_gaussian_peaks_recover_their_parameters():
    x = np.arange(-20, 21)
    cases = [(h, m, s) for h in (0.3, 0.9) for m in (-6.3, 0.0, 5.8) for s in (1.5, 3.0)]
    c = np.stack([h * np.exp(-((x - m) ** 2) / (2 * s * s)) for h, m, s in cases])
    got = K.gaussian_peaks(1.0, (-15, 15))(c)
    assert got[:, 1] == pytest.approx([k[0] for k in cases], abs=1e-3) and got[:, 0] == pytest.approx([k[1] for k in cases], abs=1e-3)
    assert got[:, 2] == pytest.approx([k[2] for k in cases], abs=1e-2) and not got[:, 3].any()
    flags = K.gaussian_peaks(1.0, (-3, 3), (0.5, 1.0), (0.25, 2.0))(c)[:, 3].astype(int)
    for (h, m, s), f in zip(cases, flags, strict=True):
        assert bool(f & K.FAIL["amp_low"]) == (h < 0.5) and bool(f & K.FAIL["width_high"]) == (s > 2)
        assert bool(f & K.FAIL["lag_low"]) == (m < -3) and bool(f & K.FAIL["lag_high"]) == (m > 3)
    assert int(K.gaussian_peaks(1.0, (-20, 20))(np.exp(-((x - 25.0) ** 2) / 50)[None])[0, 3]) & K.FAIL["edge"]


def test_regression_matches_least_squares():
    g = np.random.default_rng(4)
    evs, x = g.normal(size=(60, 3)), g.normal(size=(5, 60))
    out = K.regression(evs)(x)
    design = np.column_stack([np.ones(60), evs])
    for row, y in zip(out, x, strict=True):
        beta, *_ = np.linalg.lstsq(design, y, rcond=None)
        assert row[:4] == pytest.approx(beta) and row[5:] == pytest.approx(y - evs @ beta[1:])
        assert row[4] == pytest.approx(1 - ((y - design @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_surrogates_keep_what_they_should():
    x = np.random.default_rng(5).normal(size=64)
    for kind in ("shuffle", "phase"):
        s = K.surrogate(np.arange(20), x, kind)
        assert (s == K.surrogate(np.arange(20), x, kind)).all()
        if kind == "shuffle":
            assert np.sort(s, axis=1) == pytest.approx(np.sort(x)[None].repeat(20, 0))
        else:
            assert np.abs(np.fft.rfft(s, axis=1)) == pytest.approx(np.abs(np.fft.rfft(x))[None].repeat(20, 0))


def test_mutual_information_is_largest_at_the_true_lag():
    g = np.random.default_rng(6)
    base = g.normal(size=1010)
    a, b = base[2:1002] ** 2, base[5:1005] ** 2
    assert K.lagged_mutual_information(6)(a[None], b[None])[0].argmax() - 6 == 3


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), min_size=4, max_size=60))
def test_spectrum_obeys_parseval(values):
    x = np.array(values)[None]
    m = K.magnitude_spectrum(x)[0] ** 2
    n = x.shape[1]
    total = 2 * m.sum() - m[0] - (m[-1] if n % 2 == 0 else 0)
    assert total / n == pytest.approx((x**2).sum(), rel=1e-6, abs=1e-6)
