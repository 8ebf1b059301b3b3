"""Maps on grids (x, y, z): neighbours, smoothing, erosion, components, comparison and pairing of maps."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagmill.operators import graphs
from lagmill.sources.tables import materialize

AXES = ("x", "y", "z")


def offsets(radius: float, center: bool = False, sizes: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> list[tuple[int, int, int, float]]:
    """(dx, dy, dz, distance) of the grid steps within radius, cells being of the given sizes."""
    reach = [int(radius // s) for s in sizes]
    out = []
    for d in product(*(range(-r, r + 1) for r in reach)):
        dist = sum((k * s) ** 2 for k, s in zip(d, sizes, strict=True)) ** 0.5
        if dist <= radius and (center or any(d)):
            out.append((*d, dist))
    return out


def neighbors(grid: DataFrame, radius: float, keys: tuple[str, ...] = (), center: bool = False, sizes: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Every cell's columns beside those of its neighbours within radius, named n_<column>, and distance. The range condition becomes an
    equality join: a cell names the places around it, of which there are as many as the radius holds, and they are looked up. The grid is not sent to all tasks,
    however small its files: written with compression, ids and places take some bytes a row, and fifty times that in memory, on the driver too."""
    steps = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(o, ("dx", "dy", "dz", "distance"), strict=True))) for o in offsets(radius, center, sizes)))
    places = grid.select("*", F.explode(steps).alias("_o"))
    places = places.select("*", *((F.col(a) + F.col(f"_o.d{a}")).alias(f"n_{a}") for a in AXES), F.col("_o.distance").alias("distance")).drop("_o")
    other = grid.select(*(F.col(c).alias(c if c in keys else f"n_{c}") for c in grid.columns))
    return places.join(other.hint("merge"), [*keys, *(f"n_{a}" for a in AXES)])


def gaussian_smooth(grid: DataFrame, value: str, sigma: float, keys: tuple[str, ...] = (), cut: float = 3.0) -> DataFrame:
    """Weighted mean of value over neighbours within cut * sigma cells, weights of a Gaussian; cells beyond the grid don't count."""
    weight = F.exp(-F.col("distance") * F.col("distance") / (2 * sigma * sigma))
    near = neighbors(grid.select(*keys, *AXES, value), cut * sigma, keys, center=True)
    return near.groupBy(*keys, *AXES).agg((F.sum(weight * F.col(f"n_{value}")) / F.sum(weight)).alias(value))


def erode(mask: DataFrame) -> DataFrame:
    """Cells of mask (x, y, z) whose six face neighbours all belong to it."""
    near = neighbors(mask.select(*AXES), 1.0)
    return near.groupBy(*AXES).agg(F.count(F.lit(1)).alias("_n")).where("_n = 6").drop("_n")


def despeckle(lags: DataFrame, threshold: float, radius: float = 1.75, keys: tuple[str, ...] = ()) -> DataFrame:
    """lags (x, y, z, lag) with median (over the neighbourhood, itself included; at most some tens of cells) and speckle: it differs from that by more than
    the threshold."""
    near = neighbors(lags.select(*keys, *AXES, "lag"), radius, keys, center=True)
    mid = near.groupBy(*keys, *AXES).agg(F.median("n_lag").alias("median"))
    return lags.join(mid, [*keys, *AXES]).withColumn("speckle", F.abs(F.col("lag") - F.col("median")) > threshold)


def components(mask: DataFrame, cell_id: str, radius: float = 1.0) -> DataFrame:
    """mask (x, y, z, cell_id) with component: the smallest id among the cells reachable over neighbours within radius."""
    cells = mask.select(*AXES, F.col(cell_id).alias("id"))
    found = graphs.components(neighbors(cells, radius).where("id < n_id"), "id", "n_id")
    rows = mask.join(found.select(F.col("id").alias(cell_id), "component"), cell_id, "left")
    return rows.withColumn("component", F.coalesce("component", cell_id))


def local_correlation(grid: DataFrame, radius: float) -> DataFrame:
    """Cells of grid (series_id, x, y, z, values standardised to unit length) with their neighbours' count and mean, smallest and largest correlation."""
    near = neighbors(grid, radius)
    r = F.aggregate(F.zip_with("values", "n_values", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = near.select("series_id", r.alias("r"))
    return rows.groupBy("series_id").agg(F.count("r").alias("n"), F.avg("r").alias("r_mean"), F.min("r").alias("r_min"), F.max("r").alias("r_max"))


def merge_pairs(samples: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """samples (keys, t, v, m) merged two by two in time: sum of v over sum of m, 0 where that is 0."""
    rows = samples.groupBy(*keys, F.floor(F.col("t") / 2).cast("int").alias("pair")).agg(F.sum("v").alias("s"), F.sum("m").alias("m"))
    return rows.select(*keys, "pair", F.when(F.col("m") > 0, F.col("s") / F.col("m")).otherwise(F.lit(0.0)).alias("v"))


def pair_differences(values: DataFrame) -> DataFrame:
    """values (subject, region, v): mean and spread over subjects of v_i - v_j for all regions i <= j; pairs with a null are left out. A
    subject's regions meet in an equality join on the subject."""
    right = values.select("subject", F.col("region").alias("j"), F.col("v").alias("vj"))
    rows = values.select("subject", F.col("region").alias("i"), F.col("v").alias("vi")).join(right, "subject").where("i <= j")
    d = F.col("vi") - F.col("vj")
    return rows.where(d.isNotNull()).groupBy("i", "j").agg(F.avg(d).alias("d_mean"), F.stddev_pop(d).alias("d_std"), F.count(F.lit(1)).alias("n"))


def refine_mask(fits: DataFrame, least_amp: float, lag_range: tuple[float, float], most_sigma: float) -> DataFrame:
    """One row: how many series pass, and fail each rule: amplitude, lag window (on the lag's size), width."""
    amp, width = F.col("strength") >= least_amp, F.col("sigma") < most_sigma
    lag = (F.abs("lag") >= lag_range[0]) & (F.abs("lag") <= lag_range[1])
    return fits.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(amp & lag & width).alias("kept"), F.count_if(~amp).alias("low_amp"),
        F.count_if(~lag).alias("outside_lag"), F.count_if(~width).alias("wide"),
    )


def symmetrize(cells: DataFrame, sign: int = 1) -> DataFrame:
    """Cells (i, j, v) of a full square matrix with (v_ij + sign * v_ji) / 2."""
    other = cells.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("_w"))
    return cells.join(other, ["i", "j"]).select("i", "j", ((F.col("v") + sign * F.col("_w")) / 2).alias("v"))


def rank_within(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first rows of each group in the given order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
