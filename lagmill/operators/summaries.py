"""Summaries of series and maps: per series, per region, per region and time, and of paired maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagmill.functions import series as S
from lagmill.operators.quantiles import medians
from lagmill.sources.tables import materialize


def series_stats(series: DataFrame) -> DataFrame:
    """Per series (series_id, values): min, max, mean, std, median, mad, skewness, kurtosis of its samples."""
    v = F.col("values")
    return series.select(
        "series_id", F.array_min(v).alias("v_min"), F.array_max(v).alias("v_max"), S.mean(v).alias("v_mean"), S.std_pop(v).alias("v_std"),
        S.median(v).alias("v_median"), S.mad(v).alias("v_mad"), S.skewness(v).alias("v_skew"), S.kurtosis(v).alias("v_kurt"),
    )


def region_timecourses(samples: DataFrame) -> DataFrame:
    """Per region and time of samples (label, t, v): mean, sum, std, median, mad and coefficient of variation in percent (0 for a zero mean)."""
    keys = ["label", "t"]
    base = samples.groupBy(*keys).agg(F.avg("v").alias("v_mean"), F.sum("v").alias("v_sum"), F.stddev_pop("v").alias("v_std"))
    mid = materialize(medians(samples, keys, "v", "v_median"), "medians")  # read twice
    away = medians(samples.join(mid, keys).select(*keys, F.abs(F.col("v") - F.col("v_median")).alias("d")), keys, "d", "mad")
    cov = F.when(F.col("v_mean") != 0, 100.0 * F.col("v_std") / F.col("v_mean")).otherwise(F.lit(0.0))
    return base.join(mid, keys).join(away, keys).select(*keys, "v_mean", "v_sum", "v_std", "v_median", (F.col("mad") / S.MAD_SCALE).alias("v_mad"), cov.alias("v_cov"))


def region_moments(maps: DataFrame, bins: int = 101) -> DataFrame:
    """Per region of maps (label, v): mean, std, median, mad, central moments 2 to 4 and the entropy (nats) of a histogram between the
    extremes of all values."""
    base = maps.groupBy("label").agg(F.avg("v").alias("v_mean"), F.stddev_pop("v").alias("v_std"), F.count("v").alias("n"))
    mid = materialize(medians(maps, ["label"], "v", "v_median"), "medians")  # read twice
    off = maps.join(base.select("label", "v_mean"), "label").join(mid, "label")
    away = medians(off.select("label", F.abs(F.col("v") - F.col("v_median")).alias("d")), ["label"], "d", "mad")
    d = F.col("v") - F.col("v_mean")
    central = off.groupBy("label").agg(*(F.avg(F.pow(d, F.lit(float(k)))).alias(f"moment{k}") for k in (2, 3, 4)))
    span = maps.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    cell = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = maps.crossJoin(F.broadcast(span)).groupBy("label", cell.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.col("n")
    entropy = counts.join(base.select("label", "n"), "label").groupBy("label").agg(F.sum(-p * F.log(p)).alias("entropy"))
    out = base.join(mid, "label").join(away, "label").join(central, "label").join(entropy, "label")
    return out.select("label", "v_mean", "v_std", "v_median", (F.col("mad") / S.MAD_SCALE).alias("v_mad"), "moment2", "moment3", "moment4", "entropy")


def line_fits(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per group the least-squares line of y on x: slope, intercept, r2 and n. One aggregation, partial before the shuffle."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n")
    )


def compare_maps(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Per group of paired values: extremes, mean and mean square of b - a and of (b - a) / a, the latter 0 where a is 0."""
    diff = F.col(b) - F.col(a)
    rel = F.when(F.col(a) != 0, diff / F.col(a)).otherwise(F.lit(0.0))
    return pairs.groupBy(*keys).agg(*(
        f.alias(f"{n}{s}") for s, d in (("diff", diff), ("reldiff", rel)) for n, f in (("min", F.min(d)), ("max", F.max(d)), ("mean", F.avg(d)), ("ms", F.avg(d * d)))
    ))


def bland_altman(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Per group: mean difference a - b, its standard deviation and limits of agreement at 1.96 of them."""
    d = F.col(a) - F.col(b)
    row = pairs.groupBy(*keys).agg(F.avg(d).alias("bias"), F.stddev_pop(d).alias("sd"))
    return row.select(*keys, "bias", "sd", (F.col("bias") - 1.96 * F.col("sd")).alias("low"), (F.col("bias") + 1.96 * F.col("sd")).alias("high"))


def icc(measures: DataFrame, keys: list[str], subject: str, session: str, value: str) -> DataFrame:
    """Per group the intraclass correlation ICC(3,1) by repeated-measures analysis of variance, with variance components and session F.

    Every subject needs one value in every session. The sums of squares come from one pass over the values and two over group means.
    """
    cells = measures.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(subject).alias("ns"), F.count_distinct(session).alias("nc"), F.avg(value).alias("m"), F.var_pop(value).alias("var")
    )
    by = lambda unit, name: measures.groupBy(*keys, unit).agg(F.avg(value).alias("u")).groupBy(*keys).agg(F.var_pop("u").alias(name))
    row = cells.join(by(subject, "vs"), keys).join(by(session, "vc"), keys)
    sst, ssr, ssc = F.col("var") * F.col("n"), F.col("vs") * F.col("n"), F.col("vc") * F.col("n")
    dfc = F.col("nc") - 1
    mse = (sst - ssr - ssc) / ((F.col("ns") - 1) * dfc)
    row = row.select(*keys, mse.alias("e_var"), (ssr / (F.col("ns") - 1)).alias("msr"), (ssc / dfc / F.col("ns")).alias("msc"), dfc.alias("dfc"), "nc")
    return row.select(
        *keys, F.coalesce((F.col("msr") - F.col("e_var")) / (F.col("msr") + F.col("dfc") * F.col("e_var")), F.lit(0.0)).alias("icc"),
        ((F.col("msr") - F.col("e_var")) / F.col("nc")).alias("r_var"), "e_var", (F.col("msc") / F.col("e_var")).alias("session_f"),
    )


def mutual_information(pairs: DataFrame, keys: list[str], x: str, y: str, bins: int = 10) -> DataFrame:
    """Per group the mutual information (nats) of x and y from a bins-by-bins joint histogram between their extremes."""
    span = pairs.groupBy(*keys).agg(*(f(c).alias(f"_{c}{n}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))), F.count(F.lit(1)).alias("_n"))
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"_{c}lo")) / (F.col(f"_{c}hi") - F.col(f"_{c}lo")) * bins), F.lit(bins - 1))
    joint = pairs.join(span, keys).groupBy(*keys, "_n", cell(x).alias("bx"), cell(y).alias("by")).agg(F.count(F.lit(1)).alias("c"))
    px = joint.groupBy(*keys, "bx").agg(F.sum("c").alias("cx"))
    py = joint.groupBy(*keys, "by").agg(F.sum("c").alias("cy"))
    term = F.col("c") / F.col("_n") * F.log(F.col("c") * F.col("_n") / (F.col("cx") * F.col("cy")))
    return joint.join(px, [*keys, "bx"]).join(py, [*keys, "by"]).groupBy(*keys).agg(F.sum(term).alias("mi"))


def mask_values(values: DataFrame, masks: list[str], value: str) -> DataFrame:
    """Per mask column: mean, std, median, mad and count of the values it holds."""
    rows = values.select(F.explode(F.array(*(F.when(F.col(m), F.lit(m)) for m in masks))).alias("mask"), F.col(value).alias("v")).where("mask is not null")
    base = rows.groupBy("mask").agg(F.avg("v").alias("v_mean"), F.stddev_pop("v").alias("v_std"), F.count("v").alias("n"))
    mid = materialize(medians(rows, ["mask"], "v", "v_median"), "medians")  # read twice
    away = medians(rows.join(mid, "mask").select("mask", F.abs(F.col("v") - F.col("v_median")).alias("d")), ["mask"], "d", "mad")
    return base.join(mid, "mask").join(away, "mask").select("mask", "v_mean", "v_std", "v_median", (F.col("mad") / S.MAD_SCALE).alias("v_mad"), "n")


def region_parabolas(samples: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Per group the least-squares parabola y = c0 + c1 x + c2 x**2, r2 and n. Power sums about the table's mean x merge before the
    shuffle; a group without three different x has nulls."""
    rows = samples.crossJoin(F.broadcast(samples.agg(F.avg(x).alias("_m")))).withColumn("_u", F.col(x) - F.col("_m"))  # one row
    u, v = F.col("_u"), F.col(y)
    powers = [F.sum(F.pow(u, F.lit(float(k)))).alias(f"s{k}") for k in range(1, 5)] + [F.sum(v * F.pow(u, F.lit(float(k)))).alias(f"t{k}") for k in range(3)]
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("_m").alias("_m"), F.var_pop(v).alias("_var"), *powers)
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    q1, q2 = s2 - s1 * s1 / n, s4 - s2 * s2 / n
    q12 = s3 - s1 * s2 / n
    y1, y2 = t1 - s1 * t0 / n, t2 - s2 * t0 / n
    det = q1 * q2 - q12 * q12
    g = g.withColumn("_a", F.when(det > 0, (y2 * q1 - y1 * q12) / det)).withColumn("_b", F.when(det > 0, (y1 * q2 - y2 * q12) / det))
    g = g.withColumn("_c", (t0 - F.col("_b") * s1 - F.col("_a") * s2) / n)
    a, b, c, m = F.col("_a"), F.col("_b"), F.col("_c"), F.col("_m")
    r2 = F.when(F.col("_var") > 0, (b * y1 + a * y2) / (F.col("_var") * n))
    return g.select(*keys, (c - b * m + a * m * m).alias("c0"), (b - 2 * a * m).alias("c1"), a.alias("c2"), r2.alias("r2"), "n")
