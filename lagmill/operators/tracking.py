"""Following a frequency through a series' spectrogram, and taking it and its harmonics out again.

A series is one row and its frames never leave its task: frames one sample apart would be as many rows as the frame has samples, times the data.
Rows of a batch are taken in blocks of about BLOCK numbers, so that memory doesn't grow with the batch. Null and empty series give null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagmill.functions import kernels as K

BLOCK = 1 << 22
#: Below this an element counts as no power, and a pair of waves as not apart.
NOTHING = 1e-12


def _in_blocks(kernel, numbers: int):
    """kernel over few enough rows at a time that each takes `numbers` numbers a sample."""

    def run(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
        step = max(1, BLOCK // (x.shape[1] * numbers))
        return np.concatenate([kernel(x[i : i + step], *(m[i : i + step] for m in more)) for i in range(0, len(x), step)])

    return run


def _framed(x: np.ndarray, segment: int) -> np.ndarray:
    """Frames of `segment` samples around every sample, beyond the ends filled with zeros."""
    half = segment // 2
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (half, segment - 1 - half))), segment, axis=1)


def ridge(gain: np.ndarray, stiffness: float) -> np.ndarray:
    """gain (rows, times, states): the path of states (rows, times) of largest total gain less stiffness for each state it moves by, of equal
    ones that of the lower state at the later time. Dynamic programming forward, then the choices are followed back."""
    rows, times, states = gain.shape
    cost = stiffness * np.abs(np.arange(states)[:, None] - np.arange(states)[None, :])
    best, came = gain[:, 0], np.zeros((times, rows, states), np.int32)
    for t in range(1, times):
        options = best[:, None, :] - cost
        came[t] = options.argmax(axis=2)
        best = gain[:, t] + options.max(axis=2)
    path = np.empty((rows, times), int)
    path[:, -1] = best.argmax(axis=1)
    for t in range(times - 1, 0, -1):
        path[:, t - 1] = came[t][np.arange(rows), path[:, t]]
    return path


def ridge_kernel(rate: float, low: float, high: float, segment: int, stiffness: float, least: float):
    """Kernel: the ridge's frequency at every sample (0 where its share of the frame's power is below `least`), then that share."""
    taper = np.hamming(segment)
    f = np.fft.rfftfreq(segment, 1 / rate)
    inner = np.arange(1, len(f) - 1)
    band = inner[(f[inner] >= low) & (f[inner] <= high)]
    if not len(band):
        raise ValueError("no frequency of the spectrum lies between the limits")

    def run(x: np.ndarray) -> np.ndarray:
        frames = _framed(x, segment)
        power = np.abs(np.fft.rfft((frames - frames.mean(axis=2, keepdims=True)) * taper, axis=2)) ** 2
        total = power[:, :, 1:].sum(axis=2)
        share = power / np.maximum(total, NOTHING)[:, :, None]
        k = band[ridge(np.log(np.maximum(share[:, :, band], NOTHING)), stiffness)]
        at = lambda d: np.take_along_axis(share, (k + d)[:, :, None], axis=2)[:, :, 0]
        a, b, c = at(-1), at(0), at(1)
        bend = a - 2 * b + c
        shift = np.where(bend < -NOTHING, np.clip((a - c) / (2 * np.where(bend < -NOTHING, bend, 1.0)), -0.5, 0.5), 0.0)
        held = (total > NOTHING) & (b >= least)
        return np.concatenate([np.where(held, (k + shift) * f[1], 0.0), np.where(total > NOTHING, b, 0.0)], axis=1)

    return _in_blocks(run, 3 * segment)


def tracked(series: DataFrame, rate: float, low: float, high: float, segment: int = 32, stiffness: float = 1.0, least: float = 0.0) -> DataFrame:
    """series (series_id, values) with frequency and share, arrays of the series' length: the frequency between low and high that the
    Hamming-tapered spectra of the frames around every sample follow best, and its share of each frame's power.

    The path maximises the sum of log shares less `stiffness` for each spectral line it moves by from sample to sample (0: every frame's
    own largest line), then a parabola through the neighbouring lines places it between them, by half a line at most. Where its share is
    below `least`, or a frame has no power, the frequency is 0.
    """
    rows = series.withColumn("_k", K.by_batch(ridge_kernel(rate, low, high, segment, stiffness, least), F.col("values")))
    return rows.withColumn("frequency", F.slice("_k", 1, F.size("values"))).withColumn("share", F.slice("_k", F.size("values") + 1, F.size("values"))).drop("_k")


def notch_kernel(rate: float, segment: int, harmonics: int):
    """Kernel of series and frequencies: in the frame around every sample the wave of its frequency that fits best in least squares is taken
    off, then from what is left those of its harmonics below half the rate; overlapping frames are averaged."""
    half = segment // 2

    def run(x: np.ndarray, frequency: np.ndarray) -> np.ndarray:
        rows, n = x.shape
        left = _framed(x, segment).copy()
        at = np.arange(segment) - half
        for j in range(1, harmonics + 2):
            f = j * frequency
            on = (frequency > 0) & (f < rate / 2)
            angle = 2 * np.pi / rate * np.where(on, f, 0.0)[:, :, None] * at
            c, s = np.cos(angle), np.sin(angle)
            cc, ss, cs = (c * c).sum(axis=2), (s * s).sum(axis=2), (c * s).sum(axis=2)
            xc, xs = (left * c).sum(axis=2), (left * s).sum(axis=2)
            det = cc * ss - cs * cs
            on &= det > 1e-6
            det = np.where(on, det, 1.0)
            p, q = np.where(on, (xc * ss - xs * cs) / det, 0.0), np.where(on, (xs * cc - xc * cs) / det, 0.0)
            left -= p[:, :, None] * c + q[:, :, None] * s
        out, count = np.zeros((rows, n + segment - 1)), np.zeros(n + segment - 1)
        for k in range(segment):
            out[:, k : k + n] += left[:, :, k]
            count[k : k + n] += 1
        return (out / count)[:, half : half + n]

    return _in_blocks(run, 6 * segment)


def cleaned(series: DataFrame, rate: float, segment: int = 32, harmonics: int = 2) -> DataFrame:
    """series (values, frequency) with cleaned: the series without the wave of its frequency at each sample, which may move, and without
    that wave's `harmonics` harmonics. Where frequency is 0 or null, frames stay as they are."""
    return series.withColumn("cleaned", K.by_batch(notch_kernel(rate, segment, harmonics), F.col("values"), F.col("frequency")))
