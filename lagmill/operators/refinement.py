"""Passes of the lag pipeline, composed: fits against a moving reference, a threshold from surrogates, speckles fitted again near their neighbours' median,
and a reference rebuilt from what holds, by mean or by leading components.

A series' correlogram, fit and alignment are one kernel over Arrow batches, so a pass reads the series and writes ids and numbers only. What
fitting again changes is a table of those cells alone, which the kernel takes in place of its own fit; nothing else is joined to the series.
The reference is one series and lives on the driver between passes. Ids are unique. A series with missing values, or of another length than the
reference, has no fit and takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagmill.functions import kernels as K
from lagmill.operators import decomposition, fits as fitting, grids, lags, quantiles
from lagmill.sources.tables import discard, materialize

#: What is fitted of a series; flags as in fits.FLAGS.
FIT = ("lag", "strength", "width", "flags")
#: Outside a window a correlogram is cut off this far under the largest value inside.
UNDER = 1e-9
#: Rows of a table of cells that is sent to all tasks, at most. A larger one meets the series in a shuffle: its files are small, but it grows with the series
#: and each pass would bring several to the driver.
MOST_SENT = 20_000


@dataclass(frozen=True)
class Peaks:
    """How a series' lag is found: correlations at lags -most..most (in samples), plain or detrended and tapered, and the kind of fit (fits.KINDS)."""

    most: int
    kind: str = "fastgauss"
    tapered: bool = True
    width: tuple[float, float] = (0.1, 100.0)

    def correlated(self, x: np.ndarray, ref: np.ndarray) -> np.ndarray:
        ready = K.corr_normalized if self.tapered else lambda v: K.standardized(v) / v.shape[1] ** 0.5
        return K.generalized_correlation(self.most, "None")(ready(x), ready(ref[None, :]))

    def kernel(self, ref: np.ndarray, reach: float = 0.0):
        """Kernel: FIT of every series; given guesses, of the highest peak within reach of each series' own."""
        fit = fitting.peak_fits(self.kind, 1.0, (-self.most, self.most), width=self.width)
        at = np.arange(-self.most, self.most + 1)

        def run(x: np.ndarray, guess: np.ndarray | None = None) -> np.ndarray:
            out = np.zeros((len(x), len(FIT)))
            out[:, 3] = fitting.FLAGS["fit_algorithm"]
            if x.shape[1] != len(ref):
                return out
            good = np.flatnonzero(np.isfinite(x).all(axis=1))
            if not len(good):
                return out
            c = self.correlated(x[good], ref)
            if guess is not None:
                inside = np.abs(at[None, :] - guess[good][:, None]) <= reach
                inside[:, [0, -1]] = False
                good, c, inside = (v[inside.any(axis=1)] for v in (good, c, inside))
                if not len(good):
                    return out
                top = np.where(inside, c, -np.inf).max(axis=1, keepdims=True)
                c = np.where(np.abs(at[None, :] - guess[good][:, None]) <= reach, c, np.minimum(c, top - UNDER))
            out[good] = fit(c)
            return out

        return run


def _numbers(rows: DataFrame, column: str, *names: str) -> DataFrame:
    kinds = [F.get(column, F.lit(i)).cast("int" if n == "flags" else "double").alias(n) for i, n in enumerate(FIT)]
    return rows.select(*names, *kinds)


def _beside(cells: DataFrame) -> DataFrame:
    """cells, of a written table, as the right side of a join with the series."""
    return F.broadcast(cells) if cells.limit(MOST_SENT + 1).count() <= MOST_SENT else cells.hint("merge")


def lag_fits(series: DataFrame, ref: np.ndarray, peaks: Peaks) -> DataFrame:
    """series_id, lag, strength, width, flags of every series against the reference."""
    return _numbers(series.select("series_id", K.by_batch(peaks.kernel(ref), F.col("values")).alias("_k")), "_k", "series_id")


def null_threshold(spark: SparkSession, ref: np.ndarray, peaks: Peaks, share: float, repeats: int, kind: str = "shuffle") -> float:
    """The strength under which `share` of `repeats` surrogates of the reference (kernels.surrogate) stay, each against the reference, by nearest rank.
    A surrogate depends on its seed alone; seeds are dealt out as rows."""
    fit = peaks.kernel(ref)
    strongest = K.by_batch(lambda seed: fit(K.surrogate(seed[:, 0], ref, kind))[:, 1], F.col("seed"), returns="double")
    null = spark.range(repeats).select(F.array(F.col("id").cast("double")).alias("seed")).select(strongest.alias("strength"))
    null = materialize(null, "lag-null")
    row = quantiles.nearest_rank(null, [], "strength", [share]).first()
    discard(null)
    return float(row["strength"]) if row else 0.0


def despeckled(series: DataFrame, cells: DataFrame, fits: DataFrame, ref: np.ndarray, peaks: Peaks, most_off: float, rounds: int = 4, radius: float = 1.75) -> DataFrame:
    """fits with x, y, z and refit. A cell (cells: series_id, x, y, z) without a good fit, or whose lag differs by more than most_off from the median lag of
    the good fits around it (its own included), is fitted again within most_off of that median; a good fit replaces the old one. At most `rounds`
    times, or until nothing changes. Only those cells' series are read."""
    now = fits.join(cells.select("series_id", "x", "y", "z").hint("merge"), "series_id").withColumn("refit", F.lit(False))
    now = materialize(now, "lag-cells")
    for _ in range(rounds):
        near = grids.neighbors(now.select("series_id", "x", "y", "z", "lag", "flags"), radius, center=True).where("n_flags = 0")
        median = near.groupBy("series_id").agg(F.median("n_lag").alias("median"))
        off = now.join(median.hint("merge"), "series_id").where((F.col("flags") != 0) | (F.abs(F.col("lag") - F.col("median")) > most_off)).select("series_id", "median")
        off = materialize(off, "lag-speckles")
        again = series.select("series_id", "values").join(_beside(off), "series_id")
        again = again.select("series_id", K.by_batch(peaks.kernel(ref, most_off), F.col("values"), F.col("median")).alias("_k"))
        again = materialize(_numbers(again, "_k", "series_id").where("flags = 0"), "lag-again")
        changed = not again.isEmpty()
        if changed:
            renamed = again.select("series_id", *(F.col(c).alias(f"_{c}") for c in FIT))
            taken = [F.coalesce(f"_{c}", c).alias(c) for c in FIT]
            new = now.join(renamed.hint("merge"), "series_id", "left").select("series_id", *taken, "x", "y", "z", (F.col("refit") | F.col("_lag").isNotNull()).alias("refit"))
            new = materialize(new, "lag-cells")
            discard(now)
            now = new
        discard(off, again)
        if not changed:
            break
    return now


def placed(series: DataFrame, ref: np.ndarray, peaks: Peaks, moved: DataFrame | None, tail, name: str) -> DataFrame:
    """series_id, FIT and the array `name`: what tail(values, lags) makes of every series at its lag, which is its own fit's or that of moved (series_id, FIT)."""
    fit = peaks.kernel(ref)

    def run(x: np.ndarray, *given: np.ndarray) -> np.ndarray:
        own, given = fit(x), np.column_stack(given)
        own = np.where(np.isnan(given), own, given)
        return np.column_stack([own, tail(np.nan_to_num(x), np.where(own[:, 3] == 0, own[:, 0], 0.0))])

    rows = series.select("series_id", "values")
    if moved is None:
        rows = rows.select("*", *(F.lit(None).cast("double").alias(f"_{c}") for c in FIT))
    else:
        rows = rows.join(_beside(moved.select("series_id", *(F.col(c).cast("double").alias(f"_{c}") for c in FIT))), "series_id", "left")
    rows = rows.select("series_id", K.by_batch(run, F.col("values"), *(F.col(f"_{c}") for c in FIT)).alias("_k"))
    return _numbers(rows.where("_k is not null"), "_k", "series_id", F.expr(f"slice(_k, {len(FIT) + 1}, size(_k) - {len(FIT)})").alias(name))


def _weighted_sums(rows: DataFrame, length: int) -> np.ndarray:
    """The sum of weights, then the weighted sums at every time, of rows (w, values): one row a task, added per cell."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length + 1)
        for batch in batches:
            if batch.num_rows:
                w = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
                total += w @ np.column_stack([np.ones(len(x)), x])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["m"])

    cells = rows.select("w", "values").mapInArrow(partial, "m array<double>").select(F.posexplode("m").alias("i", "v"))
    out = np.zeros(length + 1)
    for r in cells.groupBy("i").agg(F.sum("v").alias("v")).collect():  # length + 1 numbers
        out[r["i"]] = r["v"]
    return out


def rebuilt_reference(series: DataFrame, ref: np.ndarray, peaks: Peaks, moved: DataFrame | None, least: float, weight: str = "R", components: int | None = None) -> np.ndarray | None:
    """The mean, weighted by strength (R), its square (R2) or not (None), of the standardised series moved earlier by their lags, of those with a good fit
    of strength `least` or more; with components, its part in the space of that many leading time courses of those series. None if there are none."""
    n = len(ref)
    rows = placed(series, ref, peaks, moved, lambda x, lag: K.shifted(K.standardized(x), -lag), "values").where((F.col("flags") == 0) & (F.col("strength") >= least))
    w = {"R": F.col("strength"), "R2": F.col("strength") * F.col("strength"), "None": F.lit(1.0)}[weight]
    sums = _weighted_sums(rows.select(w.alias("w"), "values"), n)
    if sums[0] <= 0:
        return None
    mean = sums[1:] / sums[0]
    if components is None:
        return mean
    _, _, products = decomposition.second_moments(rows, n)
    leading = np.linalg.eigh(products)[1][:, ::-1][:, :components]
    return leading @ (leading.T @ mean)


@dataclass(frozen=True)
class Passes:
    """What composed passes found: fits (series_id, FIT and, with cells, x, y, z, refit), the reference they hold against, the least strength, how many
    passes were run, and the fits that come from fitting again (None without cells)."""

    fits: DataFrame
    ref: np.ndarray
    least: float
    passes: int
    moved: DataFrame | None


def composed_passes(series: DataFrame, peaks: Peaks, cells: DataFrame | None = None, passes: int = 3, share: float = 0.95, repeats: int = 10_000, least: float | None = None, most_off: float = 5.0,
                    rounds: int = 4, weight: str = "R", components: int | None = None, tolerance: float = 1e-4) -> Passes:
    """Fit all series (series_id, values), despeckle (with cells), take the least strength from `repeats` surrogates (unless it is given), rebuild the reference,
    and again. Ends after `passes`, or when the standardised reference moves by less than tolerance in mean square, or nothing is left to
    rebuild it from. Tables of passes gone by are deleted. An empty table has no reference and is an error."""
    spark = series.sparkSession
    row = lags.reference_series(series).first()
    if row is None or not row["ref"]:
        raise ValueError("there are no series to make a reference from")
    ref = np.asarray(row["ref"], float)
    for k in range(passes):
        found = materialize(lag_fits(series, ref, peaks), "lag-fits")
        moved = None
        if cells is not None:
            first, found = found, despeckled(series, cells, found, ref, peaks, most_off, rounds)
            discard(first)
            moved = found.where("refit").select("series_id", *FIT)
        limit = null_threshold(spark, ref, peaks, share, repeats) if least is None else least
        if k == passes - 1:
            break
        new = rebuilt_reference(series, ref, peaks, moved, limit, weight, components)
        if new is None:
            break
        shift = ((K.standardized(new[None, :]) - K.standardized(ref[None, :])) ** 2).mean()
        if shift < tolerance:
            break
        discard(found)
        ref = new
    return Passes(found, ref, limit, k + 1, moved)


def regressed(series: DataFrame, found: Passes, peaks: Peaks) -> DataFrame:
    """series_id, FIT, slope, intercept, r and filtered: the series without the standardised reference at its own lag (lag 0 without a good fit). A series
    of another length than the reference, or a constant one, stays as it is, with slope and r 0."""
    ref = K.standardized(found.ref[None, :])

    def tail(x: np.ndarray, lag: np.ndarray) -> np.ndarray:
        if x.shape[1] != ref.shape[1]:
            return np.column_stack([np.zeros((len(x), 3)), x])
        moved = K.shifted(np.repeat(ref, len(x), axis=0), lag)
        mean, centre = x.mean(axis=1, keepdims=True), moved.mean(axis=1, keepdims=True)
        dx, dm = x - mean, moved - centre
        xm, mm, xx = (dx * dm).sum(axis=1), (dm * dm).sum(axis=1), (dx * dx).sum(axis=1)
        slope = np.where(mm > 0, xm / np.where(mm > 0, mm, 1), 0)
        both = np.sqrt(mm * xx)
        r = np.where(both > 0, xm / np.where(both > 0, both, 1), 0)
        return np.column_stack([slope, mean[:, 0] - slope * centre[:, 0], r, x - slope[:, None] * dm])

    rows = placed(series, found.ref, peaks, found.moved, tail, "_t")
    parts = [F.get("_t", F.lit(i)).alias(n) for i, n in enumerate(("slope", "intercept", "r"))]
    return rows.select("series_id", *FIT, *parts, F.expr("slice(_t, 4, size(_t) - 3)").alias("filtered"))
