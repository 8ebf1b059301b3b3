"""A waveform at the rate of slices from volumes whose slices were taken one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagmill.functions import series as S
from lagmill.sources.tables import to_samples


def slice_series(series: DataFrame, scaled: bool = True) -> DataFrame:
    """series (slice, weight, values) as slice, values and norm: the mean over the slice's rows of weight * value at every time, of rows whose
    weight isn't 0; scaled by median and median deviation, of which norm is the latter, else 1. Sums merge before the shuffle; a slice's
    series is one row. Null weights and values don't count."""
    rows = to_samples(series.where("weight != 0").select("slice", F.col("weight").cast("double").alias("weight"), "values"))
    means = rows.where("v is not null").groupBy("slice", "t").agg(F.avg(F.col("weight") * F.col("v")).alias("v"))
    whole = means.groupBy("slice").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("values"))
    if not scaled:
        return whole.withColumn("norm", F.lit(1.0))
    return whole.select("slice", S.normalize(F.col("values"), "mad").alias("values"), S.mad(F.col("values")).alias("norm"))


def slice_waveform(series: DataFrame, offsets: DataFrame, n_steps: int, sign: float = -1.0, scaled: bool = True, multiplicative: bool = False) -> DataFrame:
    """The waveform that slices taken at different times of a cycle make together: t (n_steps a volume, from 0), v, cycle.

    series: slice, weight, values (a row per cell); offsets: slice, offset (which of the n_steps of a cycle it is taken at, see frames.slice_offsets). A
    slice's series stands at n_steps * time + offset, slices of one offset add up, and each offset's mean over time, cycle, is taken off (or, with
    multiplicative, what it divides by 1 + itself). Offsets without a slice are 0 throughout. An empty table gives no rows.
    """
    slices = slice_series(series, scaled).join(offsets.select("slice", F.col("offset").cast("int").alias("offset")), "slice")
    placed = slices.select("offset", F.posexplode("values").alias("k", "v")).groupBy("offset", "k").agg((sign * F.sum("v")).alias("v"))
    length = slices.agg(F.max(F.size("values")).alias("n")).where("n is not null")
    frame = length.select(F.explode(F.sequence(F.lit(0), F.col("n") * n_steps - 1)).alias("t")).select("t", (F.col("t") % n_steps).alias("offset"), F.floor(F.col("t") / n_steps).cast("int").alias("k"))
    full = frame.join(placed, ["offset", "k"], "left").select("t", "offset", F.coalesce("v", F.lit(0.0)).alias("v"))
    cycle = full.groupBy("offset").agg(F.avg("v").alias("cycle"))
    rows = full.join(F.broadcast(cycle), "offset")  # n_steps rows
    out = F.col("v") / (1 + F.col("cycle")) if multiplicative else F.col("v") - F.col("cycle")
    return rows.select("t", out.alias("v"), "cycle")
