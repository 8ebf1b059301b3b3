"""Numpy kernels over Arrow batches of series: what column functions can't express. Each works on a matrix (series, time) of one
batch; rows are independent, so no shuffle is needed and memory is bounded by a batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Pass bands in Hz, and the stops of a band that has its own.
BANDS = {
    "vlf": (0.0, 0.009), "lfo": (0.01, 0.15), "lfo_legacy": (0.01, 0.15, 0.009, 0.2), "lfo_tight": (0.01, 0.1), "resp": (0.2, 0.5), "cardiac": (0.66, 3.0),
    "hrv_ulf": (0.0, 0.0033), "hrv_vlf": (0.0033, 0.04), "hrv_lf": (0.04, 0.15), "hrv_hf": (0.15, 0.4), "hrv_vhf": (0.4, 0.5),
}
TRANSITION = 0.05


def by_batch(kernel: Callable[..., np.ndarray], *columns: Column, returns: str = "array<double>") -> Column:
    """kernel applied to the matrices of the given array columns, and to vectors of plain number columns; series of different lengths go
    through it by length (of the first column). Null series give null. Pass columns, not expressions with lambdas: those would be
    moved into the call, where they can't be evaluated."""

    @pandas_udf(returns)
    def run(*parts: pd.Series) -> pd.Series:
        out = [None] * len(parts[0])
        length = parts[0].map(lambda a: -1 if a is None else len(a))
        for n in length.unique():
            if n > 0:
                at = np.flatnonzero(length == n)
                got = kernel(*(np.stack(p.iloc[at].to_numpy()).astype(np.float64) if p.dtype == object else p.to_numpy(np.float64)[at] for p in parts))
                for i, row in zip(at, got, strict=True):
                    out[i] = row
        found = pd.Series(out, dtype=object)
        return found.astype("float64") if returns == "double" else found

    return run(*columns)


def standardized(x: np.ndarray) -> np.ndarray:
    spread = x.std(axis=1, keepdims=True)
    return (x - x.mean(axis=1, keepdims=True)) / np.where(spread > 0, spread, 1)


def padded(x: np.ndarray, n: int) -> np.ndarray:
    """x with n reflected samples on either side."""
    n = min(n, x.shape[1])
    return np.concatenate([x[:, :n][:, ::-1], x, x[:, x.shape[1] - n :][:, ::-1]], axis=1)


def transfer(f: np.ndarray, low: float, high: float, kind: str, order: int = 6, stops: tuple[float, float] | None = None) -> np.ndarray:
    """Gain at frequencies f of a zero-phase filter that passes low..high; low 0 makes it a low-pass, high 0 a high-pass. stops: where a trapezoid's
    ramps end, TRANSITION beyond the band if not given."""
    low_stop, high_stop = stops or (low * (1 - TRANSITION), high * (1 + TRANSITION))

    def low_pass(edge: float, stop: float) -> np.ndarray:
        if kind == "brickwall":
            return (f <= edge).astype(float)
        if kind == "trapezoidal":
            return np.clip((stop - f) / (stop - edge), 0, 1)
        if kind == "gaussian":
            return np.exp(-((f / edge) ** 2) / 2)
        if kind == "butterworth":  # forward and backward: the squared magnitude
            return 1 / (1 + (f / edge) ** (2 * order))
        raise ValueError(f"no filter {kind!r}")

    gain = np.ones_like(f)
    if high > 0 and high < f[-1]:
        gain = gain * low_pass(high, high_stop)
    if low > 0:
        gain = gain * (1 - low_pass(low_stop, low))
    return gain


def band_filter(rate: float, band: str | tuple[float, ...], kind: str = "trapezoidal", stop: bool = False, pad_seconds: float = 30.0) -> Callable[[np.ndarray], np.ndarray]:
    """Zero-phase band-pass, or what it leaves out (stop), with reflected padding. A band is low, high and
    its stops, if it has its own. A band above the Nyquist frequency is an error."""
    low, high, *stops = BANDS[band] if isinstance(band, str) else band
    if low >= rate / 2:
        raise ValueError("the band lies above the Nyquist frequency")

    def run(x: np.ndarray) -> np.ndarray:
        n = min(int(pad_seconds * rate), x.shape[1])
        y = padded(x, n)
        f = np.fft.rfftfreq(y.shape[1], 1 / rate)
        out = np.fft.irfft(np.fft.rfft(y, axis=1) * transfer(f, low, high, kind, stops=tuple(stops) or None), y.shape[1], axis=1)[:, n : n + x.shape[1]]
        return x - out if stop else out

    return run


def notch(rate: float, frequency: float, percent: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    """Removes a frequency and its harmonics below Nyquist, percent of each to either side and one bin at least."""

    def run(x: np.ndarray) -> np.ndarray:
        f = np.fft.rfftfreq(x.shape[1], 1 / rate)
        gain = np.ones_like(f)
        for h in np.arange(frequency, rate / 2, frequency):
            gain[np.abs(f - h) <= max(h * percent / 100, f[1])] = 0
        return np.fft.irfft(np.fft.rfft(x, axis=1) * gain, x.shape[1], axis=1)

    return run


def poly_detrend(order: int) -> Callable[[np.ndarray], np.ndarray]:
    """Residual of the least-squares polynomial of the given order; one projection for the whole batch."""

    def run(x: np.ndarray) -> np.ndarray:
        q, _ = np.linalg.qr(np.vander(np.linspace(-1, 1, x.shape[1]), order + 1))
        return x - x @ q @ q.T

    return run


def nearest_root(low: float, high: float) -> Callable[[np.ndarray], np.ndarray]:
    """Rows c: the real root of 1 + c[0] x + c[1] x**2 + ... of least size within low..high, or 0 where there is none. The roots' reciprocals
    are the eigenvalues of a matrix with ones below the diagonal and -c in its first row, whatever coefficients are 0."""

    def run(c: np.ndarray) -> np.ndarray:
        m = np.zeros((len(c), c.shape[1], c.shape[1]))
        m[:, 0] = -c
        m[:, np.arange(1, c.shape[1]), np.arange(c.shape[1] - 1)] = 1
        y = np.linalg.eigvals(m)
        real = (np.abs(y.imag) <= 1e-9 * np.maximum(np.abs(y), 1)) & (np.abs(y) > 1e-12)
        x = 1 / np.where(real, y.real, np.inf)
        ok = real & (x >= low) & (x <= high)
        size = np.where(ok, np.abs(x), np.inf)
        return np.where(ok.any(axis=1), np.take_along_axis(x, size.argmin(axis=1)[:, None], 1)[:, 0], 0.0)

    return run


def savgol(length: int, order: int) -> Callable[[np.ndarray], np.ndarray]:
    """Savitzky-Golay smoothing; the ends are taken from the polynomial of the first and last whole window."""
    half = length // 2
    a = np.vander(np.arange(-half, half + 1), order + 1, increasing=True).astype(float)
    h = a @ np.linalg.pinv(a)  # row i: weights for position i of a window

    def run(x: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(x, 2 * half + 1, axis=1)
        return np.concatenate([view[:, 0] @ h[:half].T, view @ h[half], view[:, -1] @ h[half + 1 :].T], axis=1)

    return run


def shifted(x: np.ndarray, by: np.ndarray, pad: int = 30) -> np.ndarray:
    """Every series moved later by its own number of samples, by phase in the frequency domain, ends reflected."""
    n = min(pad, x.shape[1])
    y = padded(x, n)
    f = np.fft.rfftfreq(y.shape[1])
    return np.fft.irfft(np.fft.rfft(y, axis=1) * np.exp(-2j * np.pi * f * by.reshape(-1, 1)), y.shape[1], axis=1)[:, n : n + x.shape[1]]


def analytic(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1)


def envelope(x: np.ndarray) -> np.ndarray:
    return np.abs(analytic(x))


def phase(x: np.ndarray) -> np.ndarray:
    """Unwrapped phase of the analytic signal."""
    return np.unwrap(np.angle(analytic(x)), axis=1)


def magnitude_spectrum(x: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.rfft(x, axis=1))


def spectral_flatness(x: np.ndarray) -> np.ndarray:
    """Geometric over arithmetic mean of the spectrum without its constant term."""
    s = np.maximum(magnitude_spectrum(x)[:, 1:], 1e-300)
    return np.exp(np.log(s).mean(axis=1)) / s.mean(axis=1)


def generalized_correlation(most: int, weighting: str = "phat", share: float = 0.1) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Cross-correlation at lags -most..most weighted in the frequency domain: None, phat, liang, eckart or regressor; bins under
    share of the largest weight are left out. Scaled so that the unweighted peak's height stays."""

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = 2 * a.shape[1]
        fa, fb = np.fft.rfft(a, n, axis=1), np.fft.rfft(b, n, axis=1)
        cross = fa * np.conj(fb)
        if weighting != "None":
            w = {"phat": np.abs(cross), "liang": (np.sqrt(np.abs(fa)) + np.sqrt(np.abs(fb))) ** 2, "eckart": np.sqrt(np.abs(fa)) * np.sqrt(np.abs(fb)), "regressor": np.abs(fb) ** 2}[weighting]
            plain = np.fft.irfft(cross, n, axis=1)
            cross = np.where(w > share * w.max(axis=1, keepdims=True), cross / np.maximum(w, 1e-300), 0)
        c = np.fft.irfft(cross, n, axis=1)
        if weighting != "None":
            c = c * np.abs(plain).max(axis=1, keepdims=True) / np.maximum(np.abs(c).max(axis=1, keepdims=True), 1e-300)
        return np.concatenate([c[:, n - most :], c[:, : most + 1]], axis=1)

    return run


def corr_normalized(x: np.ndarray) -> np.ndarray:
    """Rows less their lines, scaled, under a Hamming window, scaled again, over the root of the length: dot products are Pearson correlations."""
    n = x.shape[1]
    t = np.arange(n) - (n - 1) / 2
    x = x - x.mean(axis=1, keepdims=True) - np.outer(x @ t / (t @ t), t)
    return standardized(standardized(x) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n))) / n**0.5


def aliased_correlation(steps: int, most: int) -> Callable[[np.ndarray, np.ndarray, np.ndarray], list]:
    """Correlograms, at the finer rate, of rows sampled at every steps-th place from an offset on with rows that have all places: the former are spread
    over their places with zeros between, both are normalised, and the root of steps makes up for the zeros. None where a row doesn't have as
    many samples as there are such places."""

    def run(lo: np.ndarray, hi: np.ndarray, offset: np.ndarray) -> list:
        n, out = hi.shape[1], [None] * len(lo)
        for k in np.unique(offset).astype(int):
            if 0 <= k < steps and -(-(n - k) // steps) == lo.shape[1]:
                at = np.flatnonzero(offset == k)
                fine = np.zeros((len(at), n))
                fine[:, k::steps] = lo[at]
                f, h = corr_normalized(fine), corr_normalized(hi[at])
                c = np.column_stack([np.einsum("ij,ij->i", f[:, max(g, 0) : n + min(g, 0)], h[:, max(-g, 0) : n - max(g, 0)]) for g in range(-most, most + 1)])
                for i, row in zip(at, c * steps**0.5, strict=True):
                    out[i] = row
        return out

    return run


def coherence(segment: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Magnitude-squared coherence by Welch's method: Hann segments that overlap by half, means removed."""
    w = np.hanning(segment + 1)[:-1]

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        def parts(x: np.ndarray) -> np.ndarray:
            v = np.lib.stride_tricks.sliding_window_view(x, segment, axis=1)[:, :: segment // 2]
            return np.fft.rfft((v - v.mean(axis=2, keepdims=True)) * w, axis=2)

        fa, fb = parts(a), parts(b)
        pab, paa, pbb = (fa * np.conj(fb)).mean(axis=1), (np.abs(fa) ** 2).mean(axis=1), (np.abs(fb) ** 2).mean(axis=1)
        return np.abs(pab) ** 2 / np.maximum(paa * pbb, 1e-300)

    return run


#: Bits of a peak fit's fail reason.
FAIL = {"amp_low": 1, "amp_high": 2, "width_low": 4, "width_high": 8, "lag_low": 16, "lag_high": 32, "edge": 64, "no_fit": 128}


def gaussian_fit(c: np.ndarray, x: np.ndarray, use: np.ndarray, p: np.ndarray, step: float, rounds: int = 12) -> np.ndarray:
    """(height, lag, sigma) of the least-squares Gaussian of every row of c over the samples that use marks, from the starts p: damped
    Gauss-Newton steps on all rows at once."""
    p = p.astype(float).copy()
    most = np.array([0.5, 2 * step, 2 * step])
    for _ in range(rounds):
        d = x[None, :] - p[:, 1:2]
        g = np.exp(-(d**2) / (2 * p[:, 2:3] ** 2))
        res = (c - p[:, :1] * g) * use
        j = np.stack([g, p[:, :1] * g * d / p[:, 2:3] ** 2, p[:, :1] * g * d**2 / p[:, 2:3] ** 3], axis=2) * use[:, :, None]
        h = np.einsum("bti,btj->bij", j, j)
        h += 1e-6 * np.eye(3) * (np.einsum("bii->b", h)[:, None, None] + 1e-12)
        move = np.linalg.solve(h, np.einsum("bti,bt->bi", j, res)[:, :, None])[:, :, 0]
        p = p + np.clip(move, -most, most)
        p[:, 2] = np.maximum(np.abs(p[:, 2]), step / 10)
    return p


def gaussian_peaks(lag_step: float, lag_range: tuple[float, float], amp: tuple[float, float] = (0.0, 1.0), sigma: tuple[float, float] = (0.25, 25.0), rounds: int = 12) -> Callable[[np.ndarray], np.ndarray]:
    """Per correlogram (lag, height, sigma, fail reason) of a Gaussian fitted to the run of samples over half of the highest inner peak: damped
    Gauss-Newton steps on all rows of a batch at once. Values outside their ranges set FAIL bits; the fit is returned as found."""

    def run(c: np.ndarray) -> np.ndarray:
        rows, n = np.arange(len(c)), c.shape[1]
        x = (np.arange(n) - n // 2) * lag_step
        k = c[:, 1:-1].argmax(axis=1) + 1
        edge = (c[rows, k] < c[rows, k - 1]) | (c[rows, k] < c[rows, k + 1])
        top = c[rows, k]
        over = c > np.maximum(top, 1e-12)[:, None] / 2
        gap = ~over
        index = np.arange(n)[None, :]
        left = np.where(gap & (index < k[:, None]), index, -1).max(axis=1) + 1
        right = np.where(gap & (index > k[:, None]), index, n).min(axis=1) - 1
        use = ((index >= np.minimum(left, k - 1)[:, None]) & (index <= np.maximum(right, k + 1)[:, None])).astype(float)
        p = np.stack([top, x[k], np.maximum((right - left + 1) * lag_step / 2.355, lag_step / 2)], axis=1)
        p = gaussian_fit(c, x, use, p, lag_step, rounds)
        bad = (
            FAIL["amp_low"] * (p[:, 0] < amp[0]) + FAIL["amp_high"] * (p[:, 0] > amp[1]) + FAIL["width_low"] * (p[:, 2] < sigma[0])
            + FAIL["width_high"] * (p[:, 2] > sigma[1]) + FAIL["lag_low"] * (p[:, 1] < lag_range[0]) + FAIL["lag_high"] * (p[:, 1] > lag_range[1])
            + FAIL["edge"] * edge + FAIL["no_fit"] * ~np.isfinite(p).all(axis=1)
        )
        return np.column_stack([p[:, 1], p[:, 0], p[:, 2], bad])

    return run


def lagged_mutual_information(most: int, bins: int | None = None) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Mutual information (nats) of the overlap of a and b at lags -most..most from joint histograms."""

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a.shape[1]
        k = bins or max(2, int(np.sqrt(n / 5)))

        def cells(x: np.ndarray) -> np.ndarray:
            lo, hi = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
            return np.minimum(((x - lo) / np.maximum(hi - lo, 1e-300) * k).astype(int), k - 1)

        ca, cb = cells(a), cells(b)
        out = np.zeros((len(a), 2 * most + 1))
        rows = np.arange(len(a))[:, None]
        for lag in range(-most, most + 1):
            x, y = ca[:, max(0, lag) : n + min(0, lag)], cb[:, max(0, -lag) : n - max(0, lag)]
            joint = np.bincount((rows * k * k + x * k + y).ravel(), minlength=len(a) * k * k).reshape(-1, k, k) / x.shape[1]
            marginal = joint.sum(axis=2, keepdims=True) * joint.sum(axis=1, keepdims=True)
            out[:, lag + most] = np.where(joint > 0, joint * np.log(np.where(joint > 0, joint, 1) / np.where(joint > 0, marginal, 1)), 0).sum(axis=(1, 2))
        return out

    return run


def regression(evs: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Per series the least-squares coefficients (intercept first), R squared, then the series less the fitted regressors (time, k),
    intercept kept; one matrix product a batch."""
    design = np.column_stack([np.ones(len(evs)), evs])
    solve = np.linalg.pinv(design)

    def run(x: np.ndarray) -> np.ndarray:
        beta = x @ solve.T
        res = x - beta @ design.T
        total = ((x - x.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
        r2 = np.where(total > 0, 1 - (res**2).sum(axis=1) / np.where(total > 0, total, 1), 0)
        return np.column_stack([beta, r2, res + beta[:, :1]])

    return run


def surrogate(seeds: np.ndarray, x: np.ndarray, kind: str = "shuffle") -> np.ndarray:
    """x (one series) once per seed: shuffled, or with random phases and the same spectrum."""
    out = np.empty((len(seeds), len(x)))
    f = np.fft.rfft(x)
    for i, s in enumerate(seeds):
        g = np.random.default_rng(int(s))
        if kind == "shuffle":
            out[i] = g.permutation(x)
        else:
            turn = np.exp(2j * np.pi * g.random(len(f)))
            turn[0] = 1
            if len(x) % 2 == 0:
                turn[-1] = 1
            out[i] = np.fft.irfft(f * turn, len(x))
    return out


def spline_matrix(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """(new, old) matrix of the cubic spline through samples at `old` (the first and last two pieces are one cubic each), evaluated at `new`; positions
    outside follow the end pieces. A spline is linear in its samples, so one matrix serves every series."""
    n, h = len(old), np.diff(old)
    if n < 4:
        return np.stack([np.interp(new, old, row) for row in np.eye(n)], axis=1)
    system, right = np.zeros((n, n)), np.zeros((n, n))  # for the second derivatives
    for i in range(1, n - 1):
        system[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        right[i, i - 1 : i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    system[0, :3] = h[1], -h[0] - h[1], h[0]
    system[-1, -3:] = h[-1], -h[-1] - h[-2], h[-2]
    curve = np.linalg.solve(system, right)
    k = np.clip(np.searchsorted(old, new, side="right") - 1, 0, n - 2)
    b = ((new - old[k]) / h[k])[:, None]
    a, unit, hk = 1 - b, np.eye(n), h[k][:, None]
    return a * unit[k] + b * unit[k + 1] + ((a**3 - a) * curve[k] + (b**3 - b) * curve[k + 1]) * hk**2 / 6


def resampled(old: np.ndarray, new: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Cubic-spline values at new positions; positions that can't move with the series are given once."""
    m = spline_matrix(np.asarray(old, float), np.asarray(new, float))
    return lambda x: x @ m.T


def upsampled(factor: int) -> Callable[[np.ndarray], np.ndarray]:
    """Cubic-spline values at factor points a sample, from the first sample to the last; the matrix follows the series' length."""

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        return x @ spline_matrix(np.arange(float(n)), np.arange((n - 1) * factor + 1) / factor).T

    return run


def real_cepstrum(x: np.ndarray) -> np.ndarray:
    """Inverse transform of the logarithm of the magnitude spectrum."""
    return np.fft.irfft(np.log(np.maximum(magnitude_spectrum(x), 1e-300)), x.shape[1], axis=1)


def polar_spectrum(x: np.ndarray) -> np.ndarray:
    """Magnitudes, then phases, of the frequencies from 0 to the Nyquist frequency."""
    f = np.fft.rfft(x, axis=1)
    return np.concatenate([np.abs(f), np.angle(f)], axis=1)


def from_polar(m: np.ndarray) -> np.ndarray:
    """Series of even length from polar_spectrum()."""
    half = m.shape[1] // 2
    return np.fft.irfft(m[:, :half] * np.exp(1j * m[:, half:]), 2 * (half - 1), axis=1)


def approximate_entropy(m: int, r: float) -> Callable[[np.ndarray], np.ndarray]:
    """ApEn(m, r): how much less often windows of m + 1 samples stay within r of each other (largest difference) than windows of m; r in
    standard deviations of the series. Rows go one by one, since each compares all its windows."""

    def closeness(x: np.ndarray, k: int, near: float) -> float:
        v = np.lib.stride_tricks.sliding_window_view(x, k)
        far = np.zeros((len(v), len(v)))
        for i in range(k):
            np.maximum(far, np.abs(v[:, i, None] - v[None, :, i]), out=far)
        return float(np.log((far <= near).mean(axis=1)).mean())

    return lambda x: np.array([closeness(row, m, r * row.std()) - closeness(row, m + 1, r * row.std()) for row in x])


def normal_tail(z: np.ndarray) -> np.ndarray:
    """Probability of a standard normal variable over z."""
    from math import erfc

    return np.array([erfc(v / 2**0.5) / 2 for v in z])
