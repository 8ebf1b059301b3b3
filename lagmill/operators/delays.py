"""Small delays from the ratio of two slopes: a series' regression on a reference and on the reference's gradient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagmill.functions import kernels as K
from lagmill.functions import series as S
from lagmill.operators.grids import despeckle
from lagmill.operators.lags import with_reference
from lagmill.operators.quantiles import medians

#: Median absolute deviation of a standard normal variable.
NORMAL_MAD = 0.6744897501960817


def slope_ratios(series: DataFrame, ref: DataFrame) -> DataFrame:
    """series (series_id, values) as series_id, ratio: slope on the gradient of the one-row ref over slope on ref; null where the latter is 0. Row-local."""
    both = with_reference(series, ref.withColumn("deriv", S.gradient(F.col("ref"))))
    rows = both.select("series_id", S.two_regressors(F.col("values"), F.col("ref"), F.col("deriv")).alias("f"))
    return rows.select("series_id", F.when(F.col("f.slope_a") != 0, F.col("f.slope_b") / F.col("f.slope_a")).alias("ratio"))


def trained(ref: DataFrame, most: float, step: float) -> DataFrame:
    """One row, lookup: an array of (ratio, delay) in order of ratio, from the reference itself moved by -most..most in steps. The ratio falls as the
    delay grows as long as delays stay within a sample; most is for the caller to choose so. The table's size is (2 * most / step) + 1."""
    count = round(most / step)
    moved = ref.select("ref", F.explode(F.transform(F.sequence(F.lit(-count), F.lit(count)), lambda k: k * F.lit(step))).alias("delay"))
    moved = moved.select("delay", K.by_batch(lambda x, d: K.shifted(x, d), F.col("ref"), F.col("delay")).alias("values"))
    found = slope_ratios(moved.withColumnRenamed("delay", "series_id"), ref).where("ratio is not null")
    return found.groupBy().agg(F.sort_array(F.collect_list(F.struct("ratio", F.col("series_id").alias("delay")))).alias("lookup"))


def delay_of(ratio: Column, lookup: Column) -> Column:
    """Delay at a ratio, between the table's entries along a line, beyond its ends as at them; null for a null ratio."""
    low = F.try_element_at(F.filter(lookup, lambda p: p["ratio"] <= ratio), F.lit(-1))
    high = F.get(F.filter(lookup, lambda p: p["ratio"] > ratio), F.lit(0))
    share = (ratio - low["ratio"]) / (high["ratio"] - low["ratio"])
    inside = low["delay"] + share * (high["delay"] - low["delay"])
    first, last = F.get(lookup, F.lit(0)), F.try_element_at(lookup, F.lit(-1))
    return F.when(ratio < first["ratio"], first["delay"]).when(ratio >= last["ratio"], last["delay"]).otherwise(inside)


def patched(cells: DataFrame, value: str, limit: float, radius: float = 1.75) -> DataFrame:
    """cells (x, y, z, value) with median, of the cell and its neighbours within radius, and patched: the value, or the median where they differ by more
    than limit times the whole map's median absolute deviation. The map's two medians are exact and distributed; nulls stay out of them and stay null."""
    whole = medians(cells.select(value), [], value, "_mid")
    off = cells.crossJoin(F.broadcast(whole)).select(F.abs(F.col(value) - F.col("_mid")).alias("_off"))  # one row
    mad = medians(off, [], "_off", "_mad").select((F.col("_mad") / NORMAL_MAD).alias("_mad"))
    rows = despeckle(cells.withColumn("lag", F.col(value)), 0.0, radius).drop("lag", "speckle").crossJoin(F.broadcast(mad))  # one row
    far = F.abs(F.col(value) - F.col("median")) > limit * F.col("_mad")
    return rows.withColumn("patched", F.when(far, F.col("median")).otherwise(F.col(value))).drop("_mad")


def prenormalized(values: Column, lag: Column, strength: Column, r2: Column, inside: Column, norm: str = "std", weight: str = "R", most_lag: float = 10.0) -> Column:
    """values over their mean, var or std, or over most_lag - lag (invlag; lags beyond give 0), times R, R2 or the sign of strength (anything else), and 0
    outside the mask. A divisor of 0 gives zeros."""
    m = S.mean(values)
    divisors = {"mean": m, "var": S.moment(values, m, 2), "std": F.sqrt(S.moment(values, m, 2)), "invlag": F.when(F.abs(lag) < most_lag, most_lag - lag).otherwise(F.lit(0.0))}
    divisor = divisors.get(norm, F.lit(1.0))
    factor = {"R": strength, "R2": r2}.get(weight, F.when(strength > 0, 1.0).otherwise(-1.0))
    scale = F.when(inside & (divisor != 0), factor / divisor).otherwise(F.lit(0.0))
    return S.let(scale, lambda f: F.transform(values, lambda v: v * f))
