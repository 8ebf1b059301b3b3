"""Maps as landscapes: filling of depressions and accumulation of flow, as rounds of joins over the edges between neighbouring cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagmill.operators.grids import AXES, neighbors
from lagmill.sources.tables import discard, materialize

#: Distance within which a cell of size 1 has its 26 neighbours.
TOUCHING = 1.75


def _is_number(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.isnan(name)


def filled(cells: DataFrame, value: str, epsilon: float = 0.0) -> DataFrame:
    """cells (id, x, y, z, value) as id, filled: the least level at which water on the cell can leave the map, over the 26 neighbours. Every step away from
    the outlet rises by epsilon at least; cells that lack a neighbour are outlets and keep their value.

    A level is the least, over the ways to an outlet, of the highest value on the way. Rounds lower the levels, first unknown, to what the
    neighbours allow, until none falls: as many rounds as the longest such way has steps. The driver sees one flag a round. Cells that no
    outlet reaches keep their value; so do nulls and NaNs, which are in nobody's way and hold no water.
    """
    known = cells.where(_is_number(value)).select("id", *AXES, F.col(value).alias("v"))
    edges = materialize(neighbors(known.select("id", *AXES), TOUCHING).select("id", "n_id"), "flood-edges")
    degree = edges.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    start = known.join(degree, "id", "left").select("id", "v", F.when(F.coalesce("n", F.lit(0)) < 26, F.col("v")).alias("level"))
    cur = materialize(start, "flood")
    while True:
        around = cur.where("level is not null").select(F.col("id").alias("n_id"), F.col("level").alias("n_level"))
        low = edges.join(around, "n_id").groupBy("id").agg(F.min("n_level").alias("low"))
        reach = F.greatest(F.col("v"), F.col("low") + epsilon)
        fallen = F.col("low").isNotNull() & (F.col("level").isNull() | (reach < F.col("level")))
        new = cur.join(low, "id", "left").select("id", "v", F.when(fallen, reach).otherwise(F.col("level")).alias("level"), fallen.alias("fallen"))
        new = materialize(new, "flood")
        discard(cur)
        cur = new
        if not new.where("fallen").limit(1).count():
            break
    discard(edges)
    lone = cells.where(~_is_number(value)).select("id", F.col(value).alias("filled"))
    return cur.select("id", F.coalesce("level", "v").alias("filled")).unionByName(lone)


def accumulated(cells: DataFrame, value: str, seed: str, exponent: float = 1.1, sizes: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """cells (id, x, y, z, value, seed) as id, load: a cell's seed and what flows into it. All of a cell's load goes on to those of its 26
    neighbours whose value is larger, in proportion to the slope to the power of exponent.

    The load that moves is passed on round by round, by one join on the written edges and one sum per cell, until nothing moves: as many rounds as the
    longest rising way has steps. A cell whose value or seed is null or NaN neither takes nor gives; its load is its seed.
    """
    known = cells.where(_is_number(value) & _is_number(seed)).select("id", *AXES, F.col(value).alias("v"))
    steps = neighbors(known, sum(s * s for s in sizes) ** 0.5 + 1e-9, sizes=sizes).where(" and ".join(f"abs(n_{a} - {a}) <= 1" for a in AXES))
    rising = steps.where("n_v > v").select("id", "n_id", F.pow((F.col("n_v") - F.col("v")) / F.col("distance"), F.lit(exponent)).alias("w"))
    whole = rising.groupBy("id").agg(F.sum("w").alias("whole"))
    edges = materialize(rising.join(whole, "id").select("id", "n_id", (F.col("w") / F.col("whole")).alias("share")), "flow-edges")
    cur = materialize(cells.select("id", F.col(seed).cast("double").alias("load"), F.when(_is_number(seed), F.col(seed).cast("double")).otherwise(F.lit(0.0)).alias("moving")), "flow")
    while cur.where("moving != 0").limit(1).count():
        given = edges.join(cur.where("moving != 0").select("id", "moving"), "id").groupBy("n_id").agg(F.sum(F.col("moving") * F.col("share")).alias("taken"))
        taken = F.coalesce("taken", F.lit(0.0))
        new = cur.join(given.withColumnRenamed("n_id", "id"), "id", "left").select("id", (F.col("load") + taken).alias("load"), taken.alias("moving"))
        new = materialize(new, "flow")
        discard(cur)
        cur = new
    discard(edges)
    return cur.select("id", "load")
