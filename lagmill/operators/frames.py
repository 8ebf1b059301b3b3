"""Moving frames over series: rolling statistics, outlier runs, event rasters, as-of fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def variability(samples: DataFrame, half: int, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """samples (keys, t, v) with variability: standard deviation over half samples to either side, fewer at the ends, plus
    the series mean; v itself where the mean isn't positive."""
    around = Window.partitionBy(*keys).orderBy("t").rowsBetween(-half, half)
    mean = F.avg("v").over(Window.partitionBy(*keys))
    return samples.withColumn("variability", F.when(mean > 0, F.stddev_pop("v").over(around) + mean).otherwise(F.col("v")))


def rolling_correlation(pairs: DataFrame, half: int, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """pairs (keys, t, a, b) with r: Pearson correlation over t - half .. t + half - 1, where that frame is whole. t counts from 0."""
    frame = Window.partitionBy(*keys).orderBy("t").rowsBetween(-half, half - 1)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = pairs.withColumn("r", F.corr("a", "b").over(frame)).withColumn("n", n)
    return rows.where((F.col("t") >= half) & (F.col("t") < F.col("n") - half)).drop("n")


def circular_extremes(samples: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Per series the largest and smallest forward difference, the last sample's successor being the first, and where (first if tied)."""
    by = Window.partitionBy(*keys).orderBy("t")
    first = F.first("v").over(by)
    step = F.coalesce(F.lead("v").over(by), first) - F.col("v")
    rows = samples.select(*keys, "t", step.alias("d"))
    return rows.groupBy(*keys).agg(
        F.max("d").alias("max_step"), F.min(F.struct((-F.col("d")).alias("d"), "t"))["t"].alias("max_at"),
        F.min("d").alias("min_step"), F.min(F.struct("d", "t"))["t"].alias("min_at"),
    )


def bad_points(flagged: DataFrame, streak: int, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """flagged (keys, t, bad) with filled: bad, or in a gap of good samples shorter than the streak, counted from the last bad sample
    (from 0 if there is none) to the next one, or to the end of the series. t counts from 0."""
    by = Window.partitionBy(*keys).orderBy("t")
    at = F.when(F.col("bad"), F.col("t"))
    before = F.coalesce(F.max(at).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.min(at).over(by.rowsBetween(1, Window.unboundedFollowing))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    gap = F.coalesce(after - before, n - before - 1)
    return flagged.withColumn("filled", F.col("bad") | (gap < streak))


def rasterize_events(events: DataFrame, ticks: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Events (keys, seq, start, duration, value) on the integer ticks 0 .. ticks - 1: per key and tick the value of the last event, by
    seq, whose [start, start + duration] holds the tick. Each event names its ticks, so the interval join is an aggregation."""
    stop = F.col("start") + F.col("duration")
    ok = (F.col("start") <= ticks - 1) & (stop >= 0) & (F.col("duration") > 0)
    first, last = F.greatest(F.ceil("start"), F.lit(0)), F.least(F.floor(stop), ticks - 1)
    rows = events.where(ok & (first <= last)).select(*keys, "seq", "value", F.explode(F.sequence(first, last)).alias("t"))
    return rows.groupBy(*keys, "t").agg(F.max_by("value", "seq").alias("v"))


def step_fill(ticks: DataFrame, steps: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """As-of fill: ticks (keys, t) with the value of the latest of steps (keys, t, value) at or before t, null before the first. One
    union and one window instead of a range join."""
    both = ticks.select(*keys, "t", F.lit(None).cast("double").alias("value"), F.lit(1).alias("_tick")).unionByName(
        steps.select(*keys, "t", F.col("value").cast("double").alias("value"), F.lit(0).alias("_tick")))
    by = Window.partitionBy(*keys).orderBy("t", "_tick").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("value", F.last("value", ignorenulls=True).over(by)).where("_tick = 1").drop("_tick")


def temporal_mask(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """Samples (t, ...) whose integer t lies in a span (start, duration): each span names its ticks, and an equality semi join keeps them."""
    kept = spans.select(F.explode(F.sequence(F.ceil("start"), F.floor(F.col("start") + F.col("duration")))).alias("t")).distinct()
    return samples.join(kept, "t", "left_semi")


def interval_statistics(events: DataFrame, keys: tuple[str, ...], seconds: Column) -> DataFrame:
    """Time-domain variability of the intervals between successive events per key, in milliseconds: n intervals, mean, sdnn, rmssd, sdsd,
    nn50 and pnn50 (percent of successive differences over 50 ms)."""
    by = Window.partitionBy(*keys).orderBy("_s", "event_id")
    rows = events.withColumn("_s", seconds).withColumn("ibi", (F.col("_s") - F.lag("_s").over(by)) * 1000)
    rows = rows.withColumn("step", F.col("ibi") - F.lag("ibi").over(by))
    far = F.sum(F.when(F.abs("step") > 50, 1).otherwise(0))
    return rows.groupBy(*keys).agg(
        F.count("ibi").alias("n"), F.avg("ibi").alias("mean_nn"), F.stddev_pop("ibi").alias("sdnn"), F.sqrt(F.avg(F.col("step") * F.col("step"))).alias("rmssd"),
        F.stddev_pop("step").alias("sdsd"), far.alias("nn50"), (100.0 * far / F.count("step")).alias("pnn50"),
    )


def phase_average(samples: DataFrame, phase: Column, value: str, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, spread and count of value per phase bin; phase in [0, 1) wraps round."""
    wrapped = phase - F.floor(phase)
    return samples.groupBy(*keys, F.floor(wrapped * bins).cast("int").alias("bin")).agg(
        F.avg(value).alias("v_mean"), F.stddev_pop(value).alias("v_std"), F.count(value).alias("n"))


def slice_offsets(slices: DataFrame, tr: float) -> DataFrame:
    """slices (group, time) with step (largest gap of the group's sorted times), n_steps (rint(tr / step)) and offset (rint(time /
    step) modulo n_steps)."""
    gap = F.col("time") - F.lag("time").over(Window.partitionBy("group").orderBy("time"))
    rows = slices.withColumn("_gap", gap).withColumn("step", F.max("_gap").over(Window.partitionBy("group"))).drop("_gap")
    rows = rows.withColumn("n_steps", F.rint(F.lit(tr) / F.col("step")).cast("long"))
    return rows.withColumn("offset", F.pmod(F.rint(F.col("time") / F.col("step")).cast("long"), F.col("n_steps")))
