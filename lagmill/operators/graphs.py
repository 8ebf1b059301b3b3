"""Graphs given as edge lists: connected components without a task that sees a whole component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagmill.sources.tables import discard, materialize

#: Edges that one task of components() takes, about.
TASK_EDGES = 500_000


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected edge list as (id, component), component the smallest id.

    Alternates large-star and small-star rounds; each is one aggregation and one join over the edges, so no group has to
    meet in one task. Every half round is written to the shared folder, in as many tasks as its edges ask for. Ids without an
    edge don't appear.
    """
    cur = materialize(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc"
    )
    seen = _digest(cur)
    parts = 8 + seen[0] // TASK_EDGES
    while seen[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large", parts)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.unionByName(down.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "cc", parts)
        now = _digest(new)
        discard(large, cur)
        cur = new
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def roots(parents: DataFrame) -> DataFrame:
    """parents (id, parent) with root: the end of every id's chain of parents, roots being their own parents; ids on a cycle get its smallest
    id. Chains halve each round (pointer jumping): two joins on written tables; the driver counts changes. Depth d takes about log2(d) rounds."""
    cur = materialize(parents.select("id", "parent"), "roots")
    rounds = 0
    while True:
        up = cur.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        new = materialize(cur.join(up, "parent").select("id", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")), "roots")
        moved = new.where("moved").limit(1).count()
        discard(cur)
        cur = new.drop("moved")
        cur._lagmill_path = new._lagmill_path
        rounds += 1
        if not moved:
            return cur.select("id", F.col("parent").alias("root"))
        if rounds > 64:  # 2**64 steps: only a cycle is that long
            return components(parents, "id", "parent").select("id", F.col("component").alias("root"))
