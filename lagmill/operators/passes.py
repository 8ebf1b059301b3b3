"""Stages of the lag pipeline: null distribution, peak fits, alignment, and the passes that refine the moving reference."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lagmill.functions import kernels as K
from lagmill.functions import series as S
from lagmill.operators import lags
from lagmill.sources.tables import materialize


def fit_peaks(corr: DataFrame, most: int, lag_step: float = 1.0, lag_range: tuple[float, float] | None = None) -> DataFrame:
    """corr (series_id, corr) with lag, strength, sigma and fail (bits of kernels.FAIL, 0 if the fit holds) of a Gaussian fit."""
    fit = K.by_batch(K.gaussian_peaks(lag_step, lag_range or (-most * lag_step, most * lag_step)), F.col("corr"))
    rows = corr.withColumn("_p", fit)
    names = ("lag", "strength", "sigma")
    return rows.select(*corr.columns, *(F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names)), F.get("_p", F.lit(3)).cast("int").alias("fail")).drop("corr")


def null_distribution(spark: SparkSession, ref: list[float], repeats: int, most: int, kind: str = "shuffle") -> DataFrame:
    """seed, strength: the largest correlation within lags -most..most of the reference with each of `repeats` surrogates of itself. The
    seeds are dealt out as rows; a surrogate depends on its seed alone."""
    x = np.asarray(ref, float)
    z = (x - x.mean()) / x.std() / np.sqrt(len(x))

    @pandas_udf("double")
    def strongest(seeds):
        import pandas as pd

        if not len(seeds):
            return pd.Series([], dtype="float64")
        s = K.surrogate(seeds.to_numpy(), z, kind)
        return pd.Series(K.generalized_correlation(most, "None")(s, np.broadcast_to(z, s.shape)).max(axis=1))

    return spark.range(repeats).select(F.col("id").alias("seed"), strongest("id").alias("strength"))


def align(series: DataFrame) -> DataFrame:
    """series (values, lag) with aligned: the standardised values moved earlier by the lag."""
    return series.withColumn("aligned", K.by_batch(lambda x, lag: K.shifted(K.standardized(x), -lag), F.col("values"), F.col("lag")))


def refine(series: DataFrame, least: float, weight: str = "R") -> DataFrame:
    """One row, ref: weighted mean, by strength (R), its square (R2) or not at all (None), of the standardised and aligned series
    (values, lag, strength, fail) whose fit holds and reaches `least`. Partial sums by time step, then one row."""
    good = series.where((F.col("fail") == 0) & (F.col("strength") >= least))
    w = {"R": F.col("strength"), "R2": F.col("strength") * F.col("strength"), "None": F.lit(1.0)}[weight]
    moved = align(good.select(w.alias("w"), "values", "lag"))
    sums = moved.select("w", F.posexplode("aligned").alias("t", "v")).groupBy("t").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
    ordered = F.sort_array(F.collect_list(F.struct("t", "v")))
    return sums.groupBy().agg(F.transform(ordered, lambda x: x["v"]).alias("ref"))


def lag_passes(series: DataFrame, most: int, passes: int = 3, least: float = 0.3, window: str | None = "hamming", tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame, int]:
    """(fits, ref, passes run): lag, strength, sigma and fail of every series (series_id, values) against a reference that starts as the mean
    series and is rebuilt after each pass from the aligned series. Stops early when the standardised reference moves by less than tolerance in mean
    square, or nothing is left to rebuild it from. Only the reference, one row, is looked at by the driver."""
    ref = materialize(lags.reference_series(series), "lag-ref")
    for k in range(passes):
        fits = fit_peaks(lags.correlograms(series, ref, most, window), most)
        fits = materialize(fits, "lag-fits")
        if k == passes - 1:
            break
        new = materialize(refine(fits, least), "lag-ref")
        row = new.crossJoin(ref.toDF("old")).select(
            S.mean(F.zip_with(S.normalize(F.col("ref"), "z"), S.normalize(F.col("old"), "z"), lambda a, b: (a - b) * (a - b))).alias("d")).first()
        if row is None or row["d"] is None:
            break
        ref = new
        if row["d"] < tolerance:
            break
    return fits, ref, k + 1


def filtered(series: DataFrame, fits: DataFrame, ref: DataFrame) -> DataFrame:
    """series with the reference at each series' own lag regressed out: slope, intercept, r, r2, filtered."""
    both = series.join(fits.select("series_id", F.when(F.col("fail") == 0, F.col("lag")).otherwise(F.lit(0.0)).alias("lag")), "series_id")
    return lags.regress_out(lags.lagged_regressors(both, ref)).drop("regressor")
