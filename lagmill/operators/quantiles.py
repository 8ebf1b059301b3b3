"""Exact order statistics, histograms and ranks of large columns.

Values are counted in bins of equal width first; the few bins in which a wanted rank falls are then ranked exactly. Counts merge before
they are shuffled, and so do equal values; windows run over bins or over the different values of one bin, so a group of any size is spread
over many tasks, unless most of its different values lie in one of its bins, as a far outlier makes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def _binned(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with _bin, the value's bin of BINS between its group's extremes."""
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    cell = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS)
    joined = df.join(span, keys) if keys else df.crossJoin(F.broadcast(span))
    return joined.withColumn("_bin", F.when(F.col("_hi") > F.col("_lo"), F.least(cell, F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")).drop("_lo", "_hi")


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: Column) -> DataFrame:
    """keys, rank, value: the values at the zero-based ranks of each group. ranks is an array of longs that may use the column n, the
    group's row count. Null values don't count."""
    rows = _binned(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value)), keys, value)
    counts = rows.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    counts = counts.withColumn("n", F.sum("_n").over(group)).withColumn("_to", F.sum("_n").over(group.orderBy("_bin")))
    wanted = counts.withColumn("rank", F.explode(F.array_distinct(ranks))).where("rank < _to and rank >= _to - _n")
    wanted = wanted.select(*keys, "_bin", "rank", (F.col("rank") - F.col("_to") + F.col("_n") + 1).alias("_k"))
    cells = rows.join(wanted.select(*keys, "_bin").distinct(), [*keys, "_bin"], "left_semi")
    # equal values are one row with a count before they meet: ties, however many, are no hot bin
    tied = cells.groupBy(*keys, "_bin", value).agg(F.count(F.lit(1)).alias("_t"))
    placed = tied.withColumn("_upto", F.sum("_t").over(Window.partitionBy(*keys, "_bin").orderBy(value)))
    found = placed.join(wanted, [*keys, "_bin"]).where("_k <= _upto and _k > _upto - _t")
    return found.select(*keys, "rank", value)


def medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys, name: each group's median, the mean of the two middle values for an even count."""
    middle = F.array(F.floor((F.col("n") - 1) / 2).cast("long"), F.floor(F.col("n") / 2).cast("long"))
    return order_statistics(df, keys, value, middle).groupBy(*keys).agg(F.avg(value).alias(name))


def nearest_rank(df: DataFrame, keys: list[str], value: str, fractions: list[float], nonzero: bool = False) -> DataFrame:
    """keys, fraction, value: the value at rank min(rint(fraction * n), n - 1). nonzero leaves zeros out."""
    df = df.where(F.col(value) != 0) if nonzero else df
    rank = lambda f: F.least(F.rint(F.lit(f) * F.col("n")).cast("long"), F.col("n") - 1)
    found = order_statistics(df, keys, value, F.array(*map(rank, fractions)))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    wanted = counts.select(*keys, F.explode(F.array(*(F.struct(F.lit(f).alias("fraction"), rank(f).alias("rank")) for f in fractions))).alias("_w")).select(*keys, "_w.*")
    return wanted.join(found, [*keys, "rank"]).select(*keys, "fraction", value)


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, low, width, count for bins of equal width from the smallest to the largest value, the last one closed; empty bins too."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    cell = F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).groupBy(cell.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = span.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", width.alias("width"))
    return frame.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), "width", F.coalesce("count", F.lit(0)).alias("count"))


def histogram_peak(hist: DataFrame, bins: int) -> DataFrame:
    """One row from a histogram: height, loc and half-height width of its highest bin (the first, the first bin and the last two aside), and
    center_of_mass."""
    points = F.sort_array(F.collect_list(F.struct("bin", (F.col("low") + F.col("width") / 2).alias("x"), F.col("count").cast("double").alias("y"))))
    row = hist.groupBy().agg(points.alias("p"))  # as many entries as bins
    inner = F.slice("p", 2, bins - 3)
    top = F.get(F.filter(inner, lambda q: q["y"] == F.array_max(F.transform(inner, lambda z: z["y"]))), F.lit(0))
    row = row.select("p", top.alias("top"))
    fall = F.get(F.filter("p", lambda q: (q["bin"] > F.col("top.bin")) & ((q["bin"] >= bins - 1) | (q["y"] <= F.col("top.y") / 2))), F.lit(0))
    weighed = lambda f: F.aggregate("p", F.lit(0.0), lambda s, q: s + f(q))
    return row.select(
        F.col("top.y").alias("height"), F.col("top.x").alias("loc"), ((fall["x"] - F.col("top.x")) * 2).alias("width"),
        (weighed(lambda q: q["x"] * q["y"]) / weighed(lambda q: q["y"])).alias("center_of_mass"),
    )


def percentile_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with name: 100 * (dense rank - 1) / (rows - 1). Ranks within a bin are offset by the distinct values of the bins before."""
    rows = _binned(df.where(F.col(value).isNotNull()), [], value)
    ordered = Window.partitionBy(F.lit(0)).orderBy("_bin")
    per_bin = rows.groupBy("_bin", value).agg(F.count(F.lit(1)).alias("_c")).groupBy("_bin").agg(F.count(F.lit(1)).alias("_d"), F.sum("_c").alias("_n"))
    offsets = per_bin.select(
        "_bin", F.coalesce(F.sum("_d").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_rows"),
    )
    dense = F.dense_rank().over(Window.partitionBy("_bin").orderBy(value))
    placed = rows.withColumn("_dense", dense).join(F.broadcast(offsets), "_bin")  # at most BINS rows
    return placed.withColumn(name, 100.0 * (F.col("_dense") + F.col("_off") - 1) / (F.col("_rows") - 1)).drop("_bin", "_dense", "_off", "_rows")
