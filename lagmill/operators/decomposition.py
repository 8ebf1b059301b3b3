"""Decompositions of large sets of series: what grows with the series is summed in Spark, what grows with a series' length alone is solved on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagmill.functions import kernels as K


def second_moments(series: DataFrame, length: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(series, sums by time, length-by-length sums of products): each batch adds its matrix product, batches are added per cell."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((length + 1, length + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(float)
                x = np.column_stack([np.ones(len(x)), x])
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["m"])

    rows = series.where(F.size("values") == length).select("values").mapInArrow(partial, "m array<double>")
    cells = rows.select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # (length + 1) ** 2 numbers
    m = np.zeros((length + 1) ** 2)
    for r in cells:
        m[r["i"]] = r["v"]
    m = m.reshape(length + 1, length + 1)
    return int(m[0, 0]), m[0, 1:], m[1:, 1:]


def common_length(series: DataFrame) -> int:
    """Length of all series; series of several lengths have no common components and are an error."""
    lengths = [r[0] for r in series.select(F.size("values")).distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError("the series differ in length; resample or split them first")
    return lengths[0] if lengths else 1


def principal_timecourses(series: DataFrame, length: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components, variances, share of variance): leading time courses of the series about their mean series, unit length, each with its largest entry
    positive."""
    n, sums, products = second_moments(series, length)
    cov = products / max(n, 1) - np.outer(sums, sums) / max(n, 1) ** 2
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1].T
    vectors = vectors * np.sign(vectors[np.arange(length), np.abs(vectors).argmax(axis=1)])[:, None]
    return vectors[:count], values[:count], values[:count] / max(values.sum(), 1e-300)


def loadings(series: DataFrame, components: np.ndarray) -> DataFrame:
    """series_id and its loading on every component."""
    return series.select("series_id", K.by_batch(lambda x: x @ components.T, F.col("values")).alias("loadings"))


def complex_components(series: DataFrame, length: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components, variances, mean) of complex series (re, im: arrays of one length): leading directions of the Hermitian covariance about the mean
    series, each of unit length and with its largest entry real and positive. Batches add the products of real and imaginary parts side by
    side, from which the complex ones follow; the driver sees (2 * length + 1) ** 2 numbers."""
    n, sums, products = second_moments(series.select(F.concat("re", "im").alias("values")), 2 * length)
    n, mean = max(n, 1), (sums[:length] + 1j * sums[length:]) / max(n, 1)
    aa, ab, bb = products[:length, :length], products[:length, length:], products[length:, length:]
    cov = (aa + bb + 1j * (ab - ab.T)) / n - np.outer(mean.conj(), mean)
    values, vectors = np.linalg.eigh(cov)
    vectors = vectors[:, ::-1].conj().T  # rows v with x = sum of (x . conj(v)) v
    largest = vectors[np.arange(length), np.abs(vectors).argmax(axis=1)]
    vectors = vectors * (np.abs(largest) / np.where(largest == 0, 1, largest))[:, None]
    return vectors[:count], values[::-1][:count], mean


def complex_scores(series: DataFrame, components: np.ndarray, mean: np.ndarray) -> DataFrame:
    """series_id with s_re and s_im, the coordinates of complex series (re, im) along components."""

    def score(re: np.ndarray, im: np.ndarray) -> np.ndarray:
        s = (re + 1j * im - mean) @ components.conj().T
        return np.column_stack([s.real, s.imag])

    k = len(components)
    both = series.select("series_id", K.by_batch(score, F.col("re"), F.col("im")).alias("s"))
    return both.select("series_id", F.slice("s", 1, k).alias("s_re"), F.slice("s", k + 1, k).alias("s_im"))


def complex_restored(scores: DataFrame, components: np.ndarray, mean: np.ndarray) -> DataFrame:
    """series_id, re and im of the complex series that scores (s_re, s_im) stand for: complex_scores() backwards, exact with all components."""

    def restore(re: np.ndarray, im: np.ndarray) -> np.ndarray:
        x = (re + 1j * im) @ components + mean
        return np.column_stack([x.real, x.imag])

    n = len(mean)
    both = scores.select("series_id", K.by_batch(restore, F.col("s_re"), F.col("s_im")).alias("x"))
    return both.select("series_id", F.slice("x", 1, n).alias("re"), F.slice("x", n + 1, n).alias("im"))


def independent_rotation(components: np.ndarray, rounds: int = 200, seed: int = 0) -> np.ndarray:
    """Independent time courses from principal ones (few rows of one series' length): symmetric fixed-point iteration with tanh."""
    x = components - components.mean(axis=1, keepdims=True)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    white = v * np.sqrt(x.shape[1])
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(x), len(x))))[0]
    for _ in range(rounds):
        y = np.tanh(w @ white)
        new = y @ white.T / x.shape[1] - np.diag((1 - y**2).mean(axis=1)) @ w
        left, _, right = np.linalg.svd(new)
        new = left @ right
        if np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < 1e-10:
            w = new
            break
        w = new
    return w @ white


def optimal_coordinates(values: np.ndarray) -> int:
    """Components to keep by the scree plot's optimal coordinates: how many exceed the line from the next value to the last one."""
    n = len(values)
    keep = 0
    for i in range(n - 2):
        slope = (values[-1] - values[i + 1]) / (n - 2 - i)
        if values[i] < values[i + 1] - slope:
            break
        keep = i + 1
    return keep


def acceleration_factor(values: np.ndarray) -> int:
    """Components to keep before the sharpest bend of the scree plot."""
    return int(np.argmax(np.diff(values, 2))) + 1 if len(values) > 2 else len(values)
