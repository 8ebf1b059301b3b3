"""Masks: made from values, moved to other grids, measured, used to cut series and maps, and grown from seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagmill.functions import series as S
from lagmill.operators import grids
from lagmill.operators.grids import AXES
from lagmill.operators.quantiles import nearest_rank
from lagmill.sources.tables import to_samples


def percentile_mask(cells: DataFrame, value: str, fraction: float, two_sided: bool = False) -> DataFrame:
    """cells with in_mask: the value lies over the table's nearest-rank fraction (two-sided: its size over that of the sizes)."""
    size = F.abs(value) if two_sided else F.col(value)
    cells = cells.withColumn("_v", size)
    edge = nearest_rank(cells, [], "_v", [fraction]).select(F.col("_v").alias("_edge"))
    return cells.crossJoin(F.broadcast(edge)).withColumn("in_mask", F.col("_v") > F.col("_edge")).drop("_v", "_edge")  # one row


def valid_series(series: DataFrame, least_std: float = 0.0) -> DataFrame:
    """Series whose samples all are numbers and vary by more than least_std."""
    bad = F.exists("values", lambda x: x.isNull() | F.isnan(x))
    return series.where((F.size("values") > 0) & ~bad).where(S.std_pop(F.col("values")) > least_std)


def between_times(series: DataFrame, start: int, end: int) -> DataFrame:
    """series cut to the samples from start to end, -1 meaning the last; both are held inside the series."""
    last = F.size("values") - 1
    hold = lambda v: F.greatest(F.lit(0), F.least(last, last if v < 0 else F.lit(v)))
    first = F.least(hold(max(start, 0)), hold(end))
    return series.withColumn("values", F.slice("values", first + 1, hold(end) - first + 1))


def scatter(grid: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """All cells of grid with the value of their row in values, 0 where there is none."""
    return grid.join(values.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def coarser(mask: DataFrame, cells: DataFrame, factor: int, least: float = 0.5) -> DataFrame:
    """Mask (x, y, z of cells) on a grid `factor` times coarser: places at least a share of whose cells belong to it; n and n_mask."""
    place = lambda df: [F.floor(F.col(a) / factor).cast("int").alias(a) for a in AXES]
    both = cells.select(*AXES).join(mask.select(*AXES).distinct().withColumn("_m", F.lit(1)), list(AXES), "left")
    rows = both.select(*place(both), "_m").groupBy(*AXES).agg(F.count(F.lit(1)).alias("n"), F.count("_m").alias("n_mask"))
    return rows.where(F.col("n_mask") >= least * F.col("n"))


def bounding_box(mask: DataFrame, margin: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per key the smallest and largest x, y and z, widened by margin, and the number of cells."""
    edges = [f for a in AXES for f in ((F.min(a) - margin).alias(f"{a}_low"), (F.max(a) + margin).alias(f"{a}_high"))]
    return mask.groupBy(*keys).agg(*edges, F.count(F.lit(1)).alias("n"))


def clusters(mask: DataFrame, cell_id: str, least: int = 1, radius: float = 1.0) -> DataFrame:
    """Cells of connected groups of at least `least` cells, with cluster: 1 for the largest (ties: smallest id first), and size."""
    parts = grids.components(mask, cell_id, radius)
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    order = F.row_number().over(grids.Window.orderBy(F.col("size").desc(), "component"))  # one row per cluster
    return parts.join(sizes.withColumn("cluster", order), "component").drop("component")


def grown(mask: DataFrame, cell_id: str, seeds: Column, radius: float = 1.0) -> DataFrame:
    """Cells that can be reached from a seed cell through the mask: the components that hold one."""
    parts = grids.components(mask, cell_id, radius)
    return parts.join(parts.where(seeds).select("component").distinct(), "component", "left_semi").drop("component")


def slice_means(series: DataFrame, axis: str = "z", weight: Column | None = None) -> DataFrame:
    """axis, t, v: weighted mean of the series of each slice at every time; partial sums merge before the shuffle."""
    w = F.lit(1.0) if weight is None else weight
    rows = to_samples(series.select(axis, w.alias("_w"), "values"))
    return rows.groupBy(axis, "t").agg((F.sum(F.col("_w") * F.col("v")) / F.sum("_w")).alias("v"))
