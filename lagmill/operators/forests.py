"""Spanning forests of edge lists, trees hung from a chosen root, and values handed down trees: all in a logarithmic number of rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagmill.operators.graphs import roots
from lagmill.sources.tables import discard, materialize


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Maximum spanning forest of edges (u, v, weight), undirected: (u, v) of its edges with u < v, and (id, tree) of every vertex that has an
    edge. Equal weights are ordered by u and v, nulls and NaNs come last, so there is one answer.

    Boruvka rounds: every tree takes its best edge to another tree, one aggregation; trees that took each other's edges become one by pointer
    jumping; edges are renamed after their trees, those inside a tree go and of several between two trees the best stays. Trees halve
    each round at least. Loops and repeated edges don't matter; both tables are written ones.
    """
    worst = F.lit(float("inf"))
    key = F.struct(F.when(F.isnan("weight"), worst).otherwise(F.coalesce(-F.col("weight").cast("double"), worst)).alias("neg"), F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
    cur = edges.where("u != v").select(F.least("u", "v").alias("c"), F.greatest("u", "v").alias("d"), key.alias("key"))
    cur = materialize(cur.groupBy("c", "d").agg(F.min("key").alias("key")), "forest")
    members = materialize(cur.select(F.explode(F.array("c", "d")).alias("id")).distinct().select("id", F.col("id").alias("tree")), "forest-trees")
    taken = [materialize(cur.select("key.lo", "key.hi").limit(0), "forest-edges")]
    while not cur.isEmpty():
        both = cur.unionByName(cur.select(F.col("d").alias("c"), F.col("c").alias("d"), "key"))
        best = materialize(both.groupBy("c").agg(F.min(F.struct("key", "d")).alias("b")).select("c", "b.d", "b.key"), "forest-best")
        taken.append(materialize(best.select("key.lo", "key.hi").distinct(), "forest-edges"))
        other = best.select(F.col("c").alias("d"), F.col("d").alias("back"))
        up = F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("d")), F.col("c")).otherwise(F.col("d"))
        hung = roots(best.join(other, "d").select(F.col("c").alias("id"), up.alias("parent")))
        left, right = hung.select(F.col("id").alias("c"), F.col("root").alias("p")), hung.select(F.col("id").alias("d"), F.col("root").alias("q"))
        merged = cur.join(left, "c").join(right, "d").where("p != q").groupBy(F.least("p", "q").alias("c"), F.greatest("p", "q").alias("d")).agg(F.min("key").alias("key"))
        new = materialize(merged, "forest")
        moved = members.join(hung.select(F.col("id").alias("tree"), "root"), "tree", "left").select("id", F.coalesce("root", "tree").alias("tree"))
        moved = materialize(moved, "forest-trees")
        discard(cur, best, members)
        cur, members = new, moved
    found = materialize(reduce(DataFrame.unionByName, taken).distinct().select(F.col("lo").alias("u"), F.col("hi").alias("v")), "forest-edges")
    discard(cur, *taken)
    return found, members


def parents(forest: DataFrame, tops: DataFrame) -> DataFrame:
    """forest (u, v), trees, hung from tops (id, one vertex a tree): (id, parent) of every vertex with an edge, tops being their own.

    An Euler tour passes every edge once each way: behind u -> v comes v -> w, w following u among v's neighbours in a circle. Cut before the
    top's first edge it is a list, whose ranks come from pointer jumping; of u -> v and v -> u the earlier one leads down. A vertex'
    neighbours meet in one window, so degrees, not trees, must fit into a task.
    """
    both = forest.select("u", "v").unionByName(forest.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = Window.partitionBy("v").orderBy("u")
    first = F.first("u").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    follow = both.select("u", "v", F.lead("u").over(around).alias("w"), first.alias("first"))
    follow = follow.join(tops.select(F.col("id").alias("v"), F.lit(True).alias("top")), "v", "left")
    last = F.col("w").isNull() & F.coalesce("top", F.lit(False))  # back at the top from its last neighbour: the tour's end
    cur = follow.select("u", "v", F.when(~last, F.col("v")).alias("su"), F.when(~last, F.coalesce("w", "first")).alias("sv"), (~last).cast("long").alias("left"))
    cur = materialize(cur, "tour")
    while not cur.where("su is not null").isEmpty():
        ahead = cur.select(F.col("u").alias("su"), F.col("v").alias("sv"), F.col("su").alias("tu"), F.col("sv").alias("tv"), F.col("left").alias("more"))
        going = cur.where("su is not null").join(ahead, ["su", "sv"]).select("u", "v", F.col("tu").alias("su"), F.col("tv").alias("sv"), (F.col("left") + F.col("more")).alias("left"))
        new = materialize(going.unionByName(cur.where("su is null")), "tour")
        discard(cur)
        cur = new
    back = cur.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("left").alias("later"))
    down = cur.join(back, ["u", "v"]).where(F.col("left") > F.col("later")).select(F.col("v").alias("id"), F.col("u").alias("parent"))
    found = materialize(down.unionByName(tops.join(forest.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id").select("id", F.col("id").alias("parent"))), "tree-parents")
    discard(cur)
    return found


def handed_down(steps: DataFrame, begin: Column) -> DataFrame:
    """steps (id, parent, step), step an array that tells for each state of the parent, counted from 0, the state of id; tops are their own
    parents and their step is not used. (id, state) when tops are in state begin, a column of steps.

    Steps compose, so pointer jumping does: whoever isn't at its top yet takes the step of the ancestor it has reached in front of its
    own. Depth d takes about log2(d) rounds.
    """
    flat = steps.select("id", "parent", "step", F.when(F.col("id") == F.col("parent"), begin.cast("int")).alias("state"))
    cur = materialize(flat, "handed")
    while not cur.where("state is null").isEmpty():
        ahead = cur.select(F.col("id").alias("parent"), F.col("parent").alias("next"), F.col("step").alias("before"), F.col("state").alias("known"))
        going = cur.where("state is null").drop("state").join(ahead, "parent")
        step = F.when(F.col("known").isNull(), F.transform("before", lambda i: F.get("step", i)))
        going = going.select("id", F.col("next").alias("parent"), step.alias("step"), F.when(F.col("known").isNotNull(), F.get("step", F.col("known"))).alias("state"))
        new = materialize(going.unionByName(cur.where("state is not null")), "handed")
        discard(cur)
        cur = new
    return cur.select("id", "state")
