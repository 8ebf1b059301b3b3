"""Partition of a mask into connected regions of like size, grown from hashed seeds."""

from __future__ import annotations

from collections import defaultdict
from hashlib import md5
from math import ceil, prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagmill.operators.grids import AXES, neighbors
from lagmill.sources.tables import discard, materialize

#: Distances within which a cell has its 6, 18 and 26 neighbours.
REACH = {6: 1.0, 18: 1.5, 26: 1.75}
#: How much a bound on sizes gives way when every region that could grow has reached it.
GIVE = 1.1
#: Places of a box, whose cells grow in one task, and rows of the races that one task settles, at most.
BOX, RUN = 1 << 15, 100_000
STATE = ("id", "dist", "region", "via")


def chance(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts alone."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def grown_regions(mask: DataFrame, count: int, seed: int = 0, alpha: float = 0.0, connectivity: int = 6, most: float | None = None) -> DataFrame:
    """mask (id, x, y, z) as id, region: count regions, numbered from 0, each connected over the 6, 18 or 26 neighbours.

    The count cells of least hash are the first cells; then in every round each free cell beside a region joins one of those around it, drawn with
    weights (size + 1) ** -alpha: an exponential race on hashes of seed, cell and region, so reruns agree however the table is dealt. The larger
    alpha, the more like the sizes. Cells that no region reaches get a null region; fewer cells than count are an error. Ids must be distinct.

    A cell joins in the round of its distance from the nearest first cell, whatever the races give, and most cells have one region to join: so boxes of cells
    grow as far as they know (see _reached), and only cells between regions race afterwards, by distance (see _settled). The jobs are as many as
    boxes that a region crosses, not as its rounds.

    most: no region gets more than most times the mean size, as it takes the cells of least hash only; when none can grow otherwise, the bound gives way
    by a tenth. That takes a job for every round, as many as the widest region is deep; the driver sees counts.
    """
    cells = materialize(mask.select("id", *AXES), "regions-mask")
    total = cells.count()
    if total < count:
        raise ValueError(f"{total} cells can't make {count} regions")
    first = cells.select("id", chance(seed, F.col("id")).alias("u")).orderBy("u", "id").limit(count)
    first = first.select("id", (F.row_number().over(Window.orderBy("u", "id")) - 1).cast("int").alias("region"))  # count rows
    if most is None:
        boxed = cells.withColumn("box", _box(cells))
        edges = materialize(neighbors(boxed, REACH[connectivity]).select("box", "id", "n_box", "n_id"), "regions-edges")
        seeds = boxed.join(F.broadcast(first), "id").select("box", "id", F.lit(0).cast("long").alias("dist"), "region", F.col("id").alias("via"))  # count rows
        seeds = materialize(seeds, "regions-first", 1)
        state = _reached(edges, seeds, count)
        done = _settled(edges, state, count, seed, alpha)
        out = materialize(cells.select("id").join(done.hint("merge"), "id", "left"), "regions")
        discard(edges, seeds, state, done, cells)
        return out
    edges = materialize(neighbors(cells, REACH[connectivity]).select("id", "n_id"), "regions-edges")
    cur = materialize(cells.select("id").join(F.broadcast(first), "id", "left"), "regions")  # count rows
    room, left = ceil(most * total / count), total - count
    while left:
        sizes = cur.where("region is not null").groupBy("region").agg(F.count(F.lit(1)).alias("size"))
        taken = cur.where("region is not null").select(F.col("id").alias("n_id"), "region").join(sizes, "region")
        taken = taken.where(F.col("size") < room)
        beside = edges.join(taken.hint("merge"), "n_id").join(cur.where("region is null").select("id").hint("merge"), "id").select("id", "region", "size").distinct()
        race = -F.log1p(-chance(seed, F.col("id"), F.col("region"))) * F.pow(F.col("size") + 1.0, F.lit(float(alpha)))
        won = beside.groupBy("id").agg(F.min(F.struct(race.alias("r"), "region", "size")).alias("w")).select("id", "w.region", "w.size")
        order = Window.partitionBy("region").orderBy(chance(seed, F.col("id"), F.lit("room")), "id")
        won = won.withColumn("k", F.row_number().over(order)).where(F.col("size") + F.col("k") <= room)
        new = cur.join(won.select("id", F.col("region").alias("new")).hint("merge"), "id", "left").select("id", F.coalesce("region", "new").alias("region"))
        new = materialize(new, "regions")
        discard(cur)
        cur, before = new, left
        left = cur.where("region is null").count()
        if left == before:
            if room >= total:
                break
            room = ceil(GIVE * room)
    discard(edges, cells)
    return cur


def _box(cells: DataFrame) -> Column:
    """Name of a cell's box: the cells' extent, its longest side halved until a box has BOX places at most."""
    ends = cells.agg(*(f(a).alias(f"{a}{k}") for a in AXES for k, f in enumerate((F.min, F.max)))).first()
    low = {a: ends[f"{a}0"] or 0 for a in AXES}
    sides = {a: (ends[f"{a}1"] or 0) - low[a] + 1 for a in AXES}
    while prod(sides.values()) > BOX:
        longest = max(sides, key=sides.get)
        sides[longest] = -(-sides[longest] // 2)
    return F.concat_ws(":", *(F.floor((F.col(a) - low[a]) / sides[a]) for a in AXES))


def _grown(edges: pd.DataFrame, known: pd.DataFrame, count: int) -> pd.DataFrame:
    """The cells of one box (edges id, n_id; known: own first cells, and cells of other boxes beside it) round by round; see _reached."""
    n, m = len(edges), len(known)
    ids, at = np.unique(np.concatenate([edges["id"], edges["n_id"], known["id"], known["via"]]), return_inverse=True)
    cell, beside, given, via = at[:n], at[n : 2 * n], at[2 * n : 2 * n + m], at[2 * n + m :]
    far = np.iinfo(np.int64).max
    dist, label = np.full(len(ids), far), np.full(len(ids), -1)
    dist[given], label[given] = known["dist"], np.where(known["region"] >= 0, known["region"], count + via)
    own = np.isin(np.arange(len(ids)), cell)
    own[given[known["own"].to_numpy(bool)]] = True
    order = np.argsort(beside, kind="stable")
    into, start = cell[order], np.searchsorted(beside[order], np.arange(len(ids) + 1))
    level = -1
    while (later := dist[(dist > level) & (dist < far)]).size:
        level = later.min()
        front = np.flatnonzero(dist == level)
        each = start[front + 1] - start[front]
        edge = np.repeat(start[front] - np.cumsum(each) + each, each) + np.arange(each.sum())
        free = dist[into[edge]] == far
        new, k = np.unique(into[edge][free], return_inverse=True)
        least, most = np.full(len(new), far), np.full(len(new), -1)
        np.minimum.at(least, k, np.repeat(label[front], each)[free])
        np.maximum.at(most, k, np.repeat(label[front], each)[free])
        dist[new], label[new] = level + 1, np.where(least == most, least, count + new)
    out = np.flatnonzero(own & (dist < far))
    sole = label[out] < count
    return pd.DataFrame({"id": ids[out], "dist": dist[out], "region": np.where(sole, label[out], -1).astype(np.int32), "via": ids[np.where(sole, out, label[out] - count)]})


def _reached(edges: DataFrame, seeds: DataFrame, count: int) -> DataFrame:
    """Every cell that a region reaches with dist, its distance from the nearest first cell, and what it joins: a region; or with region -1 that of the cell
    via, which is itself where regions meet.

    Boxes grow by themselves from their first cells and what is known of the cells beside them, until those no longer change: one more job for every box
    that a path crosses. Distances only fall to the true ones, and a cell's label follows from those of nearer cells."""
    bridges = materialize(edges.where("box <> n_box").select("box", F.col("n_id").alias("id")).distinct(), "regions-bridges")
    own = seeds.withColumn("own", F.lit(True))
    kind = edges.schema["id"].dataType.simpleString()
    schema = f"id {kind}, dist long, region int, via {kind}"
    seen, known, drop = None, own, []
    while True:
        state = edges.groupBy("box").cogroup(known.groupBy("box")).applyInPandas(lambda e, k: _grown(e, k, count), schema)
        state = materialize(state, "regions-reached")
        outside = materialize(bridges.join(state.hint("merge"), "id").select("box", *STATE), "regions-outside")
        now = tuple(outside.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("box", *STATE))).first())
        discard(*drop)
        if now == seen or not now[0]:
            discard(outside, bridges)
            return state
        seen, known, drop = now, own.unionByName(outside.withColumn("own", F.lit(False))), [state, outside]


def _settled(edges: DataFrame, state: DataFrame, count: int, seed: int, alpha: float) -> DataFrame:
    """id, region of every cell of state. The cells where regions meet race in order of their distance, with the sizes that regions have there: consecutive
    distances, as many as have RUN rows in all, are one task; a distance with more is dealt over several, as its races don't wait for each other."""
    text = lambda c: F.col(c).cast("string")
    met = state.where("region < 0 and via = id").select("id", "dist")
    near = state.select(F.col("id").alias("n_id"), F.col("dist").alias("n_dist"), "region", "via")
    races = edges.select("id", "n_id").join(met.hint("merge"), "id").join(near.hint("merge"), "n_id").where("n_dist = dist - 1")
    races = materialize(races.select("dist", text("id").alias("id"), "region", F.when(F.col("region") < 0, text("via")).alias("via")).distinct(), "regions-races")
    levels = races.groupBy("dist").agg(F.count(F.lit(1)).alias("n")).orderBy("dist").collect()  # no more than the widest region is deep
    marks, kept = np.array([r["dist"] for r in levels]), []

    @F.pandas_udf("int")
    def place(dist):
        return pd.Series(np.searchsorted(marks, dist.to_numpy(), side="right"), dtype="int32")

    at = place("dist")
    # How many cells of a region, or of the cell via, count from the k-th of these distances on.
    tally = state.groupBy("region", F.when(F.col("region") < 0, text("via")).alias("via"), at.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    tally = materialize(tally.where(F.col("k") < len(levels)), "regions-tally")
    rows = {r["k"]: r["n"] for r in tally.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    races = races.withColumn("k", at - 1)
    lo = 0
    while lo < len(levels):
        hi, weight = lo + 1, levels[lo]["n"]
        while hi < len(levels) and weight + levels[hi]["n"] + rows.get(hi, 0) <= RUN:
            weight += levels[hi]["n"] + rows.get(hi, 0)
            hi += 1
        known = _known(kept)
        if known is None:
            named = lambda df: df
        else:
            named = lambda df: df.join(known.toDF("via", "_r").hint("merge"), "via", "left").withColumn("region", F.coalesce("_r", "region")).drop("_r")  # noqa: E731, B023
        sizes = named(tally.where(F.col("k") <= lo)).groupBy("region").agg(F.sum("n").alias("n")).collect()  # count rows
        size = np.zeros(count)
        for r in sizes:
            size[r["region"]] = r["n"]
        inside = named(tally.where((F.col("k") > lo) & (F.col("k") < hi))).select("k", F.lit(None).cast("string").alias("id"), "region", "via", "n")
        now = named(races.where((F.col("k") >= lo) & (F.col("k") < hi))).select("k", "id", "region", "via", F.lit(0).cast("long").alias("n"))
        part = F.pmod(F.xxhash64("id"), F.lit(ceil(weight / RUN))) if hi == lo + 1 else F.lit(0)
        won = inside.unionByName(now).withColumn("part", part).groupBy("part").applyInPandas(_race(size, seed, alpha), "id string, region int")
        kept.append(materialize(won, "regions-won"))
        lo = hi
    won = _known(kept)
    done = state.select("id", "region", text("via").alias("via"))
    if won is not None:
        done = done.join(won.toDF("via", "_r").hint("merge"), "via", "left").select("id", F.coalesce(F.when(F.col("region") < 0, F.col("_r")), "region").alias("region"))
    done = materialize(done.select("id", "region"), "regions-done")
    discard(races, tally, *kept)
    return done


def _known(tables: list[DataFrame]) -> DataFrame | None:
    out = None
    for df in tables:
        out = df if out is None else out.unionByName(df)
    return out


def _race(size: np.ndarray, seed: int, alpha: float):
    """Kernel: id and region of the races of consecutive distances k (id, and a region or a cell via, per region beside it), from the sizes at the first; rows
    without an id add n cells to a region, or to that of the cell via, from the distance k on."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sizes, won = size.copy(), {}
        by = defaultdict(lambda: ([], []))
        for k, cell, region, via, n in zip(rows["k"], rows["id"], rows["region"], rows["via"], rows["n"], strict=True):
            by[k][cell is not None].append((cell, region, via, n))
        for k in sorted(by):
            for _, region, via, n in by[k][0]:
                sizes[region if region >= 0 else won[via]] += n
            best = {}
            for cell, region, via, _ in by[k][1]:
                r = int(region if region >= 0 else won[via])
                u = int(md5(f"{seed}:{cell}:{r}".encode()).hexdigest()[:13], 16) / (1 << 52)  # as chance()
                best[cell] = min(best.get(cell, (np.inf, r)), (-np.log1p(-u) * (sizes[r] + 1.0) ** alpha, r))
            won |= {cell: r for cell, (_, r) in best.items()}
        return pd.DataFrame({"id": pd.Series(list(won), dtype=object), "region": pd.Series(list(won.values()), dtype="int32")})

    return run
