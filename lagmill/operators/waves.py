"""Physiological waveforms: phase projection on a grid, heart rate, quality scores, envelopes and echoes, series by series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagmill.functions import kernels as K
from lagmill.functions import series as S


def grid_average(samples: DataFrame, keys: list[str], phase: Column, value: Column, bins: int, width: float = 1.5, kernel: str = "gauss") -> DataFrame:
    """Values gridded on `bins` points of a cycle: each sample adds to the points within width bins of its phase (in cycles), weighted by a Gaussian or
    Kaiser-Bessel kernel; keys, bin, v, weight. A sample names its points, and the sums merge before the shuffle."""
    reach = int(width)
    place = (phase - F.floor(phase)) * bins
    near = F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.floor(place).cast("int") + k)).alias("p")
    rows = samples.select(*keys, place.alias("at"), value.alias("v"), near)
    d = F.abs(F.col("at") - F.col("p"))
    if kernel == "gauss":
        weight = F.exp(-d * d / (2 * (width / 2) ** 2))
    else:  # the kernel's Bessel function is smooth on [0, beta]; a short power series gives it to double precision
        x = (np.pi * width) ** 2 * (1 - F.pow(d / width, F.lit(2.0))) / 4
        weight, term = F.lit(1.0), F.lit(1.0)
        for k in range(1, 20):
            term = term * x / (k * k)
            weight = weight + term
    rows = rows.where(d <= width).withColumn("w", weight).withColumn("bin", F.pmod("p", F.lit(bins)))
    return rows.groupBy(*keys, "bin").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"), F.sum("w").alias("weight"))


def dominant_frequency(series: DataFrame, rate: float, low: float, high: float) -> DataFrame:
    """series_id, frequency, share: the strongest frequency (parabola through its neighbours) of the Hamming-tapered spectrum between low and high,
    and its share of the band's power."""

    def peak(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        s = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * np.hamming(n), axis=1))
        f = np.fft.rfftfreq(n, 1 / rate)
        band = np.flatnonzero((f >= low) & (f <= high))
        band = band[(band > 0) & (band < len(f) - 1)]
        if not len(band):
            return np.full((len(x), 2), np.nan)
        k = band[s[:, band].argmax(axis=1)]
        rows = np.arange(len(x))
        a, b, c = s[rows, k - 1], s[rows, k], s[rows, k + 1]
        bend = a - 2 * b + c
        shift = np.where(np.abs(bend) > 1e-12, np.clip(0.5 * (a - c) / np.where(np.abs(bend) > 1e-12, bend, 1), -0.5, 0.5), 0)
        power = (s[:, band] ** 2).sum(axis=1)
        return np.column_stack([(k + shift) * f[1], np.where(power > 0, b**2 / np.where(power > 0, power, 1), 0)])

    rows = series.select("series_id", K.by_batch(peak, F.col("values")).alias("p"))
    return rows.select("series_id", F.get("p", F.lit(0)).alias("frequency"), F.get("p", F.lit(1)).alias("share"))


def spectrogram(series: DataFrame, segment: int, step: int) -> DataFrame:
    """series_id, start, magnitudes: Hann-tapered spectra of overlapping segments of every series."""
    taper = np.hanning(segment + 1)[:-1]

    def frames(x: np.ndarray) -> np.ndarray:
        v = np.lib.stride_tricks.sliding_window_view(x, segment, axis=1)[:, ::step]
        return np.abs(np.fft.rfft(v * taper, axis=2)).reshape(len(x), -1)

    width = segment // 2 + 1
    rows = series.where(F.size("values") >= segment).select("series_id", K.by_batch(frames, F.col("values")).alias("m"))
    at = F.explode(F.sequence(F.lit(0), (F.size("m") / width).cast("int") - 1))
    return rows.select("series_id", "m", at.alias("k")).select("series_id", (F.col("k") * step).alias("start"), F.slice("m", F.col("k") * width + 1, F.lit(width)).alias("magnitudes"))


def quality(series: DataFrame, rate: float, window: int) -> DataFrame:
    """Rolling quality of waveforms: per series the mean, median and spread over whole windows (every half window) of skewness and Pearson kurtosis, zero crossings
    a second and spectral flatness."""
    starts = F.explode(F.sequence(F.lit(0), F.size("values") - window, F.lit(max(1, window // 2)))).alias("start")
    rows = series.where(F.size("values") >= window).select("series_id", "values", starts).select("series_id", "start", F.slice("values", F.col("start") + 1, F.lit(window)).alias("values"))
    v = F.col("values")
    crossings = lambda a: S.let(S.normalize(a, "None"), lambda d: F.size(F.filter(d, lambda x, i: (i > 0) & (x * F.get(d, i - 1) < 0))))
    rows = rows.select("series_id", S.skewness(v).alias("skew"), (S.kurtosis(v) + 3).alias("kurt"), (crossings(v) * rate / window).alias("crossings"), K.by_batch(K.spectral_flatness, v, returns="double").alias("flatness"))
    stats = [f(c).alias(f"{c}_{n}") for c in ("skew", "kurt", "crossings", "flatness") for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_pop))]
    return rows.groupBy("series_id").agg(*stats, F.count(F.lit(1)).alias("n"))


def kalman_smooth(series: DataFrame, process: float, noise: float) -> DataFrame:
    """series_id, values: a local-level Kalman filter forward, then the Rauch-Tung-Striebel pass back; all series of a batch step together."""

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        level, var = x[:, 0].copy(), noise
        levels, variances, ahead = np.empty_like(x), np.empty(n), np.empty(n)
        for t in range(n):
            ahead[t] = var + process
            if t:
                gain = ahead[t] / (ahead[t] + noise)
                level, var = level + gain * (x[:, t] - level), (1 - gain) * ahead[t]
            levels[:, t], variances[t] = level, var
        for t in range(n - 2, -1, -1):
            back = variances[t] / ahead[t + 1]
            levels[:, t] += back * (levels[:, t + 1] - levels[:, t])
        return levels

    return series.select("series_id", K.by_batch(run, F.col("values")).alias("values"))


def peak_envelope(samples: DataFrame) -> DataFrame:
    """samples (series_id, t, v) with envelope: straight lines between local maxima, the first and last held towards the ends; null where a series has
    none. Two windows over each series instead of a loop."""
    from pyspark.sql import Window

    by = Window.partitionBy("series_id").orderBy("t")
    top = (F.col("v") > F.lag("v").over(by)) & (F.col("v") >= F.lead("v").over(by))
    rows = samples.withColumn("_p", F.when(top, F.struct("t", "v")))
    before = F.last("_p", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_p", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_a", F.coalesce(before, after)).withColumn("_b", F.coalesce(after, before))
    span = F.col("_b.t") - F.col("_a.t")
    share = F.when(span > 0, (F.col("t") - F.col("_a.t")) / span).otherwise(F.lit(0.0))
    return rows.withColumn("envelope", F.col("_a.v") + share * (F.col("_b.v") - F.col("_a.v"))).drop("_p", "_a", "_b")


def peak_intervals(v: Column, off: float) -> Column:
    """Column: struct (n, mean, spread) of the intervals, in samples, between a series' local maxima, without those that differ from their median by
    more than the share `off`."""
    peaks = F.filter(F.transform(v, lambda x, i: F.when((x > F.get(v, i - 1)) & (x >= F.get(v, i + 1)), i)), lambda i: i.isNotNull())
    gaps = S.let(peaks, lambda p: F.filter(F.transform(p, lambda t, i: (t - F.get(p, i - 1)).cast("double")), lambda d: d.isNotNull()))
    kept = S.let(gaps, lambda g: S.let(S.median(g), lambda m: F.filter(g, lambda d: (d >= (1 - off) * m) & (d <= (1 + off) * m))))
    return S.let(kept, lambda g: F.when(F.size(g) > 0, F.struct(F.size(g).cast("long").alias("n"), S.mean(g).alias("mean"), S.std_pop(g).alias("spread"))))


def prewhiten(order: int):
    """Kernel: residuals of an autoregression of the given order fitted by Yule and Walker's equations; the first samples use what there is."""

    def run(x: np.ndarray) -> np.ndarray:
        y = x - x.mean(axis=1, keepdims=True)
        n = y.shape[1]
        acf = np.stack([(y[:, k:] * y[:, : n - k]).sum(axis=1) / n for k in range(order + 1)], axis=1)
        index = np.abs(np.arange(order)[:, None] - np.arange(order)[None, :])
        toeplitz = acf[:, index] + 1e-12 * np.eye(order)
        phi = np.linalg.solve(toeplitz, acf[:, 1:, None])[:, :, 0]
        out = y.copy()
        for k in range(1, order + 1):
            out[:, k:] -= phi[:, k - 1 : k] * y[:, : n - k]
        return out

    return run


def deconvolve(strength: float = 0.1):
    """Kernel of two arguments: Wiener deconvolution of a series by a response of the same length."""

    def run(x: np.ndarray, response: np.ndarray) -> np.ndarray:
        f, h = np.fft.rfft(x, axis=1), np.fft.rfft(response, axis=1)
        return np.fft.irfft(f * np.conj(h) / (np.abs(h) ** 2 + strength**2), x.shape[1], axis=1)

    return run


def cepstral_delay(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Kernel: delay, in samples, at which x holds an echo of y, over the first half.

    The spectrum of a signal with an echo is the signal's times 1 + a exp(-i w d), whose logarithm is periodic in w, so the power cepstrum of
    x + y stands out at d against that of x - y, where the echo's sign is turned. Power spectra have no phase to unwrap.
    """

    def power_cepstrum(v: np.ndarray) -> np.ndarray:
        return np.fft.irfft(np.log(np.maximum(np.abs(np.fft.rfft(v, axis=1)) ** 2, 1e-12)), v.shape[1], axis=1)

    change = power_cepstrum(x + y) - power_cepstrum(x - y)
    change[:, 0] = -np.inf
    return change[:, : change.shape[1] // 2].argmax(axis=1).astype(float)
