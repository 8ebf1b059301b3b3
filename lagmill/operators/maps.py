"""Maps over series: paired volumes, tests across measurements, atlases, gradients, run comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagmill.operators.grids import AXES
from lagmill.operators.summaries import compare_maps


def paired_correlation(samples: DataFrame) -> dict[str, DataFrame]:
    """samples (series_id, t, v) whose even and odd times are pairs (0, 1), (2, 3), ...: Pearson correlation over pairs per series and over series per pair."""
    side = lambda k: F.sum(F.when(F.col("t") % 2 == k, F.col("v")))
    pairs = samples.groupBy("series_id", F.floor(F.col("t") / 2).cast("int").alias("pair")).agg(side(0).alias("a"), side(1).alias("b"))
    pairs = pairs.where("a is not null and b is not null")
    return {k: pairs.groupBy(k).agg(F.corr("a", "b").alias("r"), F.count(F.lit(1)).alias("n")) for k in ("series_id", "pair")}


def paired_t(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Per group the paired t statistic of a - b: mean difference, t and degrees of freedom."""
    d = F.col(a) - F.col(b)
    row = pairs.groupBy(*keys).agg(F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_sd"), F.count(d).alias("_n"))
    t = F.when(F.col("_sd") > 0, F.col("mean_diff") / (F.col("_sd") / F.sqrt("_n")))
    return row.select(*keys, "mean_diff", t.alias("t"), (F.col("_n") - 1).alias("dof"))


def independent_t(values: DataFrame, keys: list[str], group: Column, value: str) -> DataFrame:
    """Per key the pooled-variance t statistic of value between the rows where group holds and the others."""
    side = lambda ok: F.when(ok, F.col(value))
    row = values.groupBy(*keys).agg(*(
        f(side(ok)).alias(f"{n}{k}") for k, ok in ((1, group), (2, ~group)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))
    ))
    dof = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    t = F.when(pooled > 0, (F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))))
    return row.select(*keys, (F.col("m1") - F.col("m2")).alias("mean_diff"), t.alias("t"), dof.alias("dof"))


def one_hot(atlas: DataFrame, labels: list[int]) -> DataFrame:
    """atlas (x, y, z, label) with one 0/1 column per given label."""
    return atlas.select(*AXES, *((F.col("label") == k).cast("int").alias(f"label_{k}") for k in labels))


def halves(atlas: DataFrame, middle: int, shift: int) -> DataFrame:
    """atlas (x, y, z, label) whose labels on the far side of x = middle are moved up by shift."""
    return atlas.withColumn("label", F.when((F.col("x") >= middle) & (F.col("label") > 0), F.col("label") + shift).otherwise(F.col("label")))


def relabel(atlas: DataFrame, classes: dict[int, list[int]]) -> DataFrame:
    """atlas with label replaced by the class whose list holds it, 0 if none does."""
    value = F.lit(0)
    for k, members in classes.items():
        value = F.when(F.col("label").isin(members), k).otherwise(value)
    return atlas.withColumn("label", value)


def gradients(grid: DataFrame, value: str) -> DataFrame:
    """grid (x, y, z, value) with g_x, g_y, g_z: half the difference of the neighbours on each axis, one-sided where there is one, null where there is
    none, and their length. A cell sends its value to its six neighbours, and one aggregation gathers them."""
    def place(axis: str, s: int) -> Column:
        return F.struct(*((F.col(a) + (s if a == axis else 0)).alias(a) for a in AXES), F.lit(f"{axis}{s}").alias("side"), F.col(value).alias("v"))

    sent = F.explode(F.array(*(place(axis, s) for axis in AXES for s in (-1, 1))))
    got = grid.select(sent.alias("m")).select("m.*")
    # a value sent by -1 arrives from the cell after
    sides = [F.max(F.when(F.col("side") == f"{a}{s}", F.col("v"))).alias(f"_{a}{'n' if s < 0 else 'p'}") for a in AXES for s in (-1, 1)]
    rows = grid.join(got.groupBy(*AXES).agg(*sides), list(AXES), "left")
    for a in AXES:
        after, before, here = F.col(f"_{a}n"), F.col(f"_{a}p"), F.col(value)
        rows = rows.withColumn(f"g_{a}", F.coalesce((after - before) / 2, after - here, here - before))
    length = F.sqrt(reduce(lambda p, q: p + q, (F.coalesce(F.col(f"g_{a}"), F.lit(0.0)) ** 2 for a in AXES)))
    return rows.withColumn("slope", length).select(*grid.columns, *(f"g_{a}" for a in AXES), "slope")


def compare_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two runs' maps (map, series_id, value): per map the comparison of the values at the same series; maps or series of one run only don't appear."""
    both = first.join(second.withColumnRenamed("value", "other"), ["map", "series_id"])
    return compare_maps(both, ["map"], "value", "other")


def same_values(first: DataFrame, second: DataFrame, most_abs: float, most_mse: float) -> DataFrame:
    """One row for two maps (series_id, value): largest and mean square difference, places in one only, and whether they match."""
    both = first.join(second.withColumnRenamed("value", "other"), "series_id", "full")
    d = F.col("value") - F.col("other")
    row = both.agg(F.max(F.abs(d)).alias("max_abs"), F.avg(d * d).alias("mse"), F.count_if(d.isNull()).alias("unmatched"))
    ok = (F.col("unmatched") == 0) & (F.coalesce("max_abs", F.lit(0.0)) <= most_abs) & (F.coalesce("mse", F.lit(0.0)) <= most_mse)
    return row.withColumn("matches", ok)


def merge_reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per JSON report; columns are all keys that occur, null where a report lacks one."""
    parts = [spark.read.json(p, multiLine=True).withColumn("report", F.lit(p)) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
