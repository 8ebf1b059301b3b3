"""Streamlines of direction fields: Runge-Kutta particles that blocks of cells advance and hand to each other."""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagmill.operators.grids import AXES
from lagmill.sources.tables import discard, materialize

#: Cells of a block along each axis, and particles that one task advances in it; more are shared among several.
BLOCK, MOST_PARTICLES = 16, 50_000
#: Least weight of cells with a direction around a point, and least length of the mean direction.
LEAST_WEIGHT, LEAST_LENGTH = 0.5, 1e-6
_PARTICLE = "seed_id long, half int, k int, x double, y double, z double, lx double, ly double, lz double, more boolean"


def _blocks_of(a: str, block: int, halo: int) -> Column:
    """Blocks, along an axis, that hold a cell or have it within their halo."""
    at = lambda c: F.floor(c / block).cast("int")
    return F.sequence(at(F.col(a) - halo), at(F.col(a) + halo))


class Field:
    """Directions of one block's cells and its halo as a dense array, absent cells 0."""

    def __init__(self, cells: pd.DataFrame, corner: np.ndarray, side: int) -> None:
        self.corner, self.side = corner, side
        self.held = np.zeros((side,) * 3 + (4,))
        i = cells[list(AXES)].to_numpy(np.int64) - corner
        self.held[i[:, 0], i[:, 1], i[:, 2]] = np.column_stack([np.ones(len(cells)), cells[["ux", "uy", "uz"]].to_numpy(float)])

    def directions(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit directions at the points by trilinear weights, and whether there is one."""
        low = np.floor(points)
        part, at = points - low, low.astype(np.int64) - self.corner
        total = np.zeros((len(points), 4))
        for d in product((0, 1), repeat=3):
            w = np.prod(np.where(d, part, 1 - part), axis=1)
            i = np.clip(at + d, 0, self.side - 1)
            total += w[:, None] * self.held[i[:, 0], i[:, 1], i[:, 2]]
        length = np.linalg.norm(total[:, 1:], axis=1)
        good = (total[:, 0] >= LEAST_WEIGHT) & (length >= LEAST_LENGTH)
        return total[:, 1:] / np.where(good, length, 1.0)[:, None], good


def _advanced(field: Field, p: pd.DataFrame, low: np.ndarray, block: int, scale: np.ndarray, most_steps: int) -> pd.DataFrame:
    """Vertices of all particles up to where they stop or leave the block; `more` marks the ones that go on elsewhere."""
    ids, k = p[["seed_id", "half"]].to_numpy(np.int64), p["k"].to_numpy(np.int64)
    at, last = p[list(AXES)].to_numpy(float), p[["lx", "ly", "lz"]].to_numpy(float)
    out = []
    while len(ids):
        ids, k, at, last = (v[k < most_steps] for v in (ids, k, at, last))
        step = ids[:, 1:] * scale
        k1, ok = field.directions(at)
        k2, good = field.directions(at + 0.5 * step * k1)
        ok &= good
        k3, good = field.directions(at + 0.5 * step * k2)
        ok &= good
        k4, good = field.directions(at + step * k3)
        ok &= good
        mean = (k1 + 2 * k2 + 2 * k3 + k4) / 6
        length = np.linalg.norm(mean, axis=1)
        ok &= length >= LEAST_LENGTH
        mean /= np.where(ok, length, 1.0)[:, None]
        ok &= ~(np.einsum("ij,ij->i", mean, last) < 0)  # a sharp turn ends a line; NaN, before the first step, doesn't
        ids, k, at, last = ids[ok], k[ok] + 1, at[ok] + (step * mean)[ok], mean[ok]
        inside = ((at >= low) & (at < low + block)).all(axis=1)
        out.append((ids, k, at, last, ~inside))
        ids, k, at, last = ids[inside], k[inside], at[inside], last[inside]
    ids, k, at, last, more = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros((0, 2), int), np.zeros(0, int), *(np.zeros((0, 3)),) * 2, np.zeros(0, bool))
    return pd.DataFrame({"seed_id": ids[:, 0], "half": ids[:, 1], "k": k, **{a: at[:, i] for i, a in enumerate(AXES)}, **{f"l{a}": last[:, i] for i, a in enumerate(AXES)}, "more": more})


def traced(field: DataFrame, seeds: DataFrame, sizes: tuple[float, float, float] = (1.0, 1.0, 1.0), step: float = 0.5, most_steps: int = 2000, block: int = BLOCK) -> DataFrame:
    """seeds (seed_id, x, y, z in cells) followed through field (x, y, z whole numbers, ux, uy, uz): seed_id, half (1 along the directions, -1 against
    them), k (steps from the seed, which is 0) and x, y, z of every vertex.

    Steps of fixed length by the classical Runge-Kutta rule in units of length; a line ends where the trilinear weight of cells with a direction
    falls under a half, where directions cancel, at a turn of over 90 degrees, or after most_steps. Cells are dealt to blocks with a halo as
    wide as a step reaches; a task advances all particles of a block at once until they leave it, and a round hands them on. Rounds end
    when no particle moves on; blocks with many particles go to several tasks. Cells with a null number and seeds with one take no part.
    """
    halo = max(2, ceil(step / min(sizes)) + 2)
    known = field.select(*(F.col(a).cast("int").alias(a) for a in AXES), "ux", "uy", "uz").dropna()
    for a in AXES:
        known = known.withColumn(f"b{a}", F.explode(_blocks_of(a, block, halo)))
    cells = materialize(known, "stream-cells")
    start = seeds.select(F.col("seed_id").cast("long").alias("seed_id"), *(F.col(a).cast("double").alias(a) for a in AXES)).dropna()
    nothing = [F.lit(float("nan")).alias(f"l{a}") for a in AXES]
    start = start.select("seed_id", F.explode(F.array(F.lit(1), F.lit(-1))).alias("half"), F.lit(0).alias("k"), *AXES, *nothing, F.lit(True).alias("more"))
    rounds = [materialize(start, "stream")]
    scale, keys = np.array([step / s for s in sizes]), ["bx", "by", "bz", "part"]

    def advance(key: tuple, moving: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        low = np.array(key[:3], np.int64) * block
        return _advanced(Field(around, low - halo, block + 2 * halo + 1), moving, low, block, scale, most_steps)

    while not rounds[-1].where("more").isEmpty():
        moving = rounds[-1].where("more").withColumns({f"b{a}": F.floor(F.col(a) / block).cast("int") for a in AXES})
        crowds = moving.groupBy("bx", "by", "bz").agg(F.ceil(F.count(F.lit(1)) / MOST_PARTICLES).cast("int").alias("parts"))
        crowds = materialize(crowds, "stream-blocks")  # a row per block that holds a particle
        dealt = moving.join(crowds, ["bx", "by", "bz"]).withColumn("part", F.pmod(F.xxhash64("seed_id", "half"), F.col("parts")).cast("int"))
        shares = crowds.select("bx", "by", "bz", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        held = cells.join(shares, ["bx", "by", "bz"])
        moved = dealt.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(advance, _PARTICLE)
        rounds.append(materialize(moved, "stream"))
        discard(crowds)
    found = materialize(reduce(DataFrame.unionByName, rounds).select("seed_id", "half", "k", *AXES), "streamlines")
    discard(cells, *rounds)
    return found


def spliced(vertices: DataFrame, sizes: tuple[float, float, float] = (1.0, 1.0, 1.0), least: float = 5.0) -> DataFrame:
    """Both halves of every line of traced() in one: seed_id, place (0 the seed, negative against the directions), x, y, z and length (of the
    line), for lines at least so long. A line's vertices, 2 * most_steps + 1 at most, meet in one window."""
    once = vertices.where("half = 1 or k > 0").withColumn("place", F.col("half") * F.col("k"))
    line = Window.partitionBy("seed_id")
    before = [F.lag(a).over(line.orderBy("place")) for a in AXES]
    gone = F.sqrt(sum((F.pow((F.col(a) - b) * s, F.lit(2.0)) for a, b, s in zip(AXES, before, sizes, strict=True)), F.lit(0.0)))
    whole = once.withColumn("gone", gone).withColumn("length", F.sum("gone").over(line))
    return whole.where(F.col("length") >= least).select("seed_id", "place", *AXES, "length")


def sampled(vertices: DataFrame, maps: DataFrame, linear: list[str], nearest: list[str] | None = None) -> DataFrame:
    """vertices (seed_id, place, x, y, z) with the values of maps (x, y, z, value columns) at them: linear ones by trilinear weights over the
    cells that have a value, nearest ones from the nearest cell (halves upwards). Null where there is none. Corners are looked up by
    equality joins."""
    numbered = vertices.select("seed_id", "place", *AXES)
    corner = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"d{a}") for v, a in zip(d, AXES, strict=True))) for d in product((0, 1), repeat=3)))).alias("d")
    spread = numbered.select("*", corner)
    weight = F.lit(1.0)
    for a in AXES:
        part = F.col(a) - F.floor(a)
        weight = weight * F.when(F.col(f"d.d{a}") == 1, part).otherwise(1 - part)
    spread = spread.select("seed_id", "place", weight.alias("w"), *((F.floor(a) + F.col(f"d.d{a}")).cast("int").alias(a) for a in AXES)).where("w > 0")
    means = [(F.sum(F.col("w") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("w")))).alias(c) for c in linear]
    out = numbered
    if linear:
        out = out.join(spread.join(maps.select(*AXES, *linear), list(AXES)).groupBy("seed_id", "place").agg(*means), ["seed_id", "place"], "left")
    if nearest:
        close = numbered.select("seed_id", "place", *(F.floor(F.col(a) + 0.5).cast("int").alias(a) for a in AXES)).join(maps.select(*AXES, *nearest), list(AXES))
        out = out.join(close.drop(*AXES), ["seed_id", "place"], "left")
    return out
