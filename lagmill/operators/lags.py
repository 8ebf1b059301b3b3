"""Lag correlation: correlograms against a moving reference, peaks, candidates, and pairs of regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagmill.functions import kernels as K
from lagmill.functions import series as S


def reference_series(series: DataFrame) -> DataFrame:
    """One row, ref: mean over all series at every time. Samples are averaged before the shuffle; the row is one series long."""
    means = series.select(F.posexplode("values").alias("t", "v")).groupBy("t").agg(F.avg("v").alias("m"))
    ordered = F.sort_array(F.collect_list(F.struct("t", "m")))
    return means.groupBy().agg(F.transform(ordered, lambda x: x["m"]).alias("ref"))


def with_reference(series: DataFrame, ref: DataFrame) -> DataFrame:
    """series with the column ref of a one-row table."""
    return series.crossJoin(F.broadcast(ref))  # one row of one series' length


def correlograms(series: DataFrame, ref: DataFrame, most: int, window: str | None = None) -> DataFrame:
    """series (series_id, values) with corr: correlations with ref at lags -most..most, a positive lag meaning that the series comes
    after the reference. window None only standardises both; else both are detrended and tapered. Row-local: no shuffle."""
    if window is None:
        prepare = lambda a: S.let(S.normalize(a, "z"), lambda z: F.transform(z, lambda x: x / F.sqrt(F.size(z).cast("double"))))
    else:
        prepare = lambda a: S.corr_normalize(a, True, window)
    ready = ref.select(prepare(F.col("ref")).alias("ref"))
    both = with_reference(series, ready).select("*", prepare(F.col("values")).alias("prepared"))
    return both.select(*series.columns, S.cross_correlation(F.col("prepared"), F.col("ref"), most).alias("corr"))


def aliased_correlograms(rows: DataFrame, lo: str, hi: str, steps: int, offset: str, most: int) -> DataFrame:
    """rows with corr: correlogram at lags -most..most, at the finer rate, of a series lo sampled at every steps-th place from offset on with a series
    hi that has all places; null where lo's length doesn't fit. Row-local, in Arrow batches; the rows' hi have one length."""
    return rows.withColumn("corr", K.by_batch(K.aliased_correlation(steps, most), F.col(lo), F.col(hi), F.col(offset)))


def best_lags(corr: DataFrame, most: int, digits: int = 9) -> DataFrame:
    """Per series the lag of the largest correlation (first after rounding to digits), its strength, the parabolic shift and refined lag
    and strength; at the edges there is no shift."""
    found = F.aggregate(
        F.transform("corr", lambda c, i: F.struct(F.round(c, digits).alias("r"), (-i).alias("i"))), F.struct(F.lit(-1e9).alias("r"), F.lit(0).alias("i")),
        lambda best, x: F.greatest(best, x))
    at = corr.withColumn("_k", -found["i"])
    left, mid, right = (F.get("corr", F.col("_k") + d) for d in (-1, 0, 1))
    bend = left - 2 * mid + right
    shift = F.when(F.abs(bend) > 1e-12, F.least(F.greatest(0.5 * (left - right) / bend, F.lit(-0.5)), F.lit(0.5))).otherwise(F.lit(0.0))
    at = at.withColumn("shift", F.coalesce(shift, F.lit(0.0))).withColumn("strength", mid)
    fine = F.when((F.col("_k") > 0) & (F.col("_k") < 2 * most), mid - 0.25 * (left - right) * F.col("shift")).otherwise(mid)
    return at.select("series_id", (F.col("_k") - most).alias("lag"), "strength", (F.col("_k") - most + F.col("shift")).alias("fine_lag"), fine.alias("fine_strength"))


def candidate_peaks(corr: DataFrame, most: int, count: int) -> DataFrame:
    """Up to count inner local maxima per series by amplitude (ties: smaller lag first): rank, lag with parabolic shift, amp."""

    def at(c, i):
        left, right = F.get("corr", i - 1), F.get("corr", i + 1)
        bend = left - 2 * c + right
        shift = F.when(F.abs(bend) > 1e-12, F.least(F.greatest(0.5 * (left - right) / bend, F.lit(-0.5)), F.lit(0.5))).otherwise(F.lit(0.0))
        return F.struct((-c).alias("neg"), (i - most + shift).alias("lag"), F.coalesce((c > left) & (c >= right), F.lit(False)).alias("ok"))

    peaks = F.slice(F.sort_array(F.filter(F.transform("corr", at), lambda p: p["ok"])), 1, count)
    rows = corr.select("series_id", F.posexplode(peaks).alias("rank", "p"))
    return rows.select("series_id", (F.col("rank") + 1).alias("rank"), F.col("p.lag").alias("lag"), (-F.col("p.neg")).alias("amp"))


def region_pairs(region_means: DataFrame, most: int) -> DataFrame:
    """Cross-correlation peak of every pair of region series (label, values), a < b: lag and strength. Pairs meet by time step: products per
    (a, b, lag) are summed from an equality join on the step, each series sending its standardised value to 2 * most + 1 steps."""
    z = region_means.select("label", F.posexplode(S.let(S.normalize(F.col("values"), "z"), lambda a: F.transform(a, lambda x: x / F.sqrt(F.size(a).cast("double"))))).alias("t", "v"))
    right = z.select(F.col("label").alias("b"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"), "t", F.col("v").alias("vb"))
    right = right.select("b", "lag", (F.col("t") + F.col("lag")).alias("t"), "vb")
    sums = z.select(F.col("label").alias("a"), "t", F.col("v").alias("va")).join(right, "t").where("a < b").groupBy("a", "b", "lag").agg(F.sum(F.col("va") * F.col("vb")).alias("r"))
    best = sums.groupBy("a", "b").agg(F.min(F.struct((-F.round("r", 9)).alias("neg"), "lag")).alias("m"))
    return best.select("a", "b", F.col("m.lag").alias("lag"), (-F.col("m.neg")).alias("strength"))


def lagged_regressors(lags: DataFrame, ref: DataFrame, factor: int = 10) -> DataFrame:
    """lags (series_id, lag) with regressor: the reference at t - lag, looked up in a table of factor points a step made by linear
    interpolation, ends held."""
    n = F.size("ref")

    def value(k):
        x = k.cast("double") / factor
        i = F.floor(x).cast("int")
        return F.get("ref", i) + (x - i) * (F.coalesce(F.get("ref", i + 1), F.get("ref", i)) - F.get("ref", i))

    table = ref.select(F.transform(F.sequence(F.lit(0), (n - 1) * factor), value).alias("_table"), n.alias("_n"))
    both = with_reference(lags, table)
    place = lambda t: F.greatest(F.lit(0), F.least((F.col("_n") - 1) * factor, F.floor((t - F.col("lag")) * factor).cast("int")))
    return both.select(*lags.columns, F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda t: F.get("_table", place(t))).alias("regressor"))


def regress_out(series: DataFrame, regressor: str = "regressor") -> DataFrame:
    """series (values and a regressor array) with slope, intercept, r, r2 and filtered: the values less slope * regressor."""
    x, y = F.col(regressor), F.col("values")
    mx, my = S.mean(x), S.mean(y)
    rows = series.select("*", mx.alias("_mx"), my.alias("_my"))
    sxy = F.aggregate(F.arrays_zip(x.alias("x"), y.alias("y")), F.lit(0.0), lambda s, p: s + (p["x"] - F.col("_mx")) * (p["y"] - F.col("_my")))
    rows = rows.select("*", sxy.alias("_sxy"), (S.moment(x, F.col("_mx"), 2) * F.size(x)).alias("_sxx"), (S.moment(y, F.col("_my"), 2) * F.size(y)).alias("_syy"))
    slope = F.when(F.col("_sxx") > 0, F.col("_sxy") / F.col("_sxx")).otherwise(F.lit(0.0))
    r = F.when((F.col("_sxx") > 0) & (F.col("_syy") > 0), F.col("_sxy") / F.sqrt(F.col("_sxx") * F.col("_syy"))).otherwise(F.lit(0.0))
    rows = rows.select("*", slope.alias("slope"), r.alias("r"))
    out = F.zip_with(y, x, lambda v, w: v - F.col("slope") * w)
    rows = rows.select("*", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), (F.col("r") * F.col("r")).alias("r2"), out.alias("filtered"))
    return rows.drop("_mx", "_my", "_sxy", "_sxx", "_syy")


def sidelobes(series: DataFrame, most: int, least: float, count: int) -> DataFrame:
    """series_id, rank, lag, amp: the highest inner local maxima of each series' autocorrelation at lags 1 .. most - 1 that reach `least`. Row-local."""
    unit = S.let(S.normalize(F.col("values"), "z"), lambda z: F.transform(z, lambda x: x / F.sqrt(F.size(z).cast("double"))))
    rows = series.select("series_id", unit.alias("u")).select("series_id", S.cross_correlation(F.col("u"), F.col("u"), most).alias("c"))
    c = F.col("c")
    top = lambda x, i: (i > most) & (i < 2 * most) & (x > F.get(c, i - 1)) & (x >= F.get(c, i + 1)) & (x >= least)
    peaks = F.filter(F.transform(c, lambda x, i: F.when(top(x, i), F.struct((-F.round(x, 9)).alias("neg"), (i - most).alias("lag"), x.alias("amp")))), lambda p: p.isNotNull())
    found = rows.select("series_id", F.posexplode(F.slice(F.sort_array(peaks), 1, count)).alias("k", "p"))
    return found.select("series_id", (F.col("k") + 1).alias("rank"), F.col("p.lag").alias("lag"), F.col("p.amp").alias("amp"))


def windowed_lags(series: DataFrame, ref: DataFrame, window: int, step: int, most: int) -> DataFrame:
    """series_id, start, lag, strength: the best lag within -most..most of every window of a series against the same window of the reference, both
    standardised; the smaller of equal lags."""
    rows = with_reference(series.where(F.size("values") >= window), ref)
    starts = F.explode(F.sequence(F.lit(0), F.size("values") - window, F.lit(step))).alias("start")
    rows = rows.select("series_id", "values", "ref", starts)
    part = lambda c: F.slice(c, F.col("start") + 1, F.lit(window))
    unit = lambda a: S.let(S.normalize(a, "z"), lambda z: F.transform(z, lambda x: x / F.sqrt(F.size(z).cast("double"))))
    rows = rows.select("series_id", "start", unit(part("values")).alias("u"), unit(part("ref")).alias("w"))
    rows = rows.select("series_id", "start", S.cross_correlation(F.col("u"), F.col("w"), most).alias("corr"))
    best = F.array_max(F.transform("corr", lambda c, i: F.struct(F.round(c, 9).alias("r"), (-i).alias("neg"), c.alias("c"))))
    return rows.select("series_id", "start", best.alias("b")).select("series_id", "start", (-F.col("b.neg") - most).alias("lag"), F.col("b.c").alias("strength"))
