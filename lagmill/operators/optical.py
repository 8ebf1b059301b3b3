"""Optical flow of correlograms on a grid: how fast and which way a pattern moves, from sums of products of derivatives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagmill.functions import kernels as K
from lagmill.functions import series as S
from lagmill.operators.grids import AXES, neighbors

#: Products of derivatives along x, y, z and the lag t that make up a cell's sums.
PRODUCTS = ("xx", "xy", "xz", "yy", "yz", "zz", "xt", "yt", "zt", "tt")


def _times(factor: float):
    return lambda v: v * factor


def derivatives(cells: DataFrame, sizes: tuple[float, float, float], lag_step: float) -> DataFrame:
    """cells (id, x, y, z, corr) with dx, dy, dz and dt: central differences of corr over the neighbours of each axis and over the lag. A cell
    stands for a neighbour that isn't there. Each cell is sent to its six neighbours once."""
    near = neighbors(cells.select("id", *AXES, "corr"), 1.0)
    pick = lambda a, s: F.first(F.when(F.col(f"n_{a}") - F.col(a) == s, F.col("n_corr")), ignorenulls=True).alias(f"{a}{'+' if s > 0 else '-'}")
    beside = near.groupBy("id").agg(*(pick(a, s) for a in AXES for s in (1, -1)))
    rows = cells.select("id", *AXES, "corr").join(beside, "id", "left")
    for a, size in zip(AXES, sizes, strict=True):
        up, down = F.coalesce(F.col(f"`{a}+`"), F.col("corr")), F.coalesce(F.col(f"`{a}-`"), F.col("corr"))
        rows = rows.withColumn(f"d{a}", F.transform(F.zip_with(up, down, lambda p, q: p - q), _times(1 / (2 * size))))
    n = F.size("corr")
    edge = lambda i: F.get("corr", F.least(F.greatest(i, F.lit(0)), n - 1))
    dt = F.transform("corr", lambda c, i: (edge(i + 1) - edge(i - 1)) / (2 * lag_step))
    return rows.select("id", *AXES, "corr", "dx", "dy", "dz", dt.alias("dt"))


def flow_sums(cells: DataFrame, sizes: tuple[float, float, float] = (1.0, 1.0, 1.0), lag_step: float = 1.0, radius: float = 1.75, weighted: bool = True) -> DataFrame:
    """cells (id, x, y, z, corr: equally long arrays over the lag) as id, x, y, z and the sums PRODUCTS: over the whole lag axis, each lag weighted by
    the positive part of the correlogram if weighted, then over the cells within radius, weighted by a Gaussian of half that radius.

    Products are row-local, so what neighbours exchange in the second join are ten numbers. A cell without corr takes no part.
    """
    rows = derivatives(cells.where("corr is not null"), sizes, lag_step)
    weight = F.transform("corr", lambda c: F.greatest(c, F.lit(0.0))) if weighted else F.transform("corr", lambda c: F.lit(1.0))
    own = rows.select("id", *AXES, *(S.total(S.product(S.product(F.col(f"d{p[0]}"), F.col(f"d{p[1]}")), weight)).alias(p) for p in PRODUCTS))
    near = neighbors(own, radius, center=True, sizes=sizes)
    fall = F.exp(-0.5 * F.pow(F.col("distance") / (radius / 2), F.lit(2.0)))
    return near.groupBy("id", *AXES).agg(*(F.sum(fall * F.col(f"n_{p}")).alias(p) for p in PRODUCTS))


def _solved(least: float, total: bool):
    def solve(m: np.ndarray) -> np.ndarray:
        xx, xy, xz, yy, yz, zz, xt, yt, zt, tt = m.T
        a = np.stack([np.stack([xx, xy, xz], 1), np.stack([xy, yy, yz], 1), np.stack([xz, yz, zz], 1)], 1)
        b = np.stack([xt, yt, zt], 1)
        values, vectors = np.linalg.eigh(a)
        high = values[:, -1:]
        keep = (values > least * high) & (high > 0)
        turned = np.einsum("nij,ni->nj", vectors, b)  # b along the eigenvectors
        rank = keep.sum(axis=1)
        if total:
            # noise in the derivatives shrinks plain least squares; in each kept direction the smallest joint eigenvalue is taken off
            joint = np.zeros((len(m), 4, 4))
            joint[:, :3, :3] = np.einsum("ni,ij->nij", np.where(keep, values, 0.0), np.eye(3))
            joint[:, :3, 3] = joint[:, 3, :3] = np.where(keep, turned, 0.0)
            joint[:, 3, 3] = tt
            for i in range(3):  # directions left out must not count as small
                joint[:, i, i] += np.where(keep[:, i], 0.0, 4 * (high[:, 0] + tt) + 1.0)
            noise = np.maximum(np.linalg.eigvalsh(joint)[:, :1], 0.0)
            part = np.where(keep & (values - noise > 1e-12 * np.maximum(high, 1e-300)), -turned / np.where(values - noise > 0, values - noise, 1.0), 0.0)
        else:
            part = np.where(keep, -turned / np.where(keep, values, 1.0), 0.0)
        v = np.einsum("nij,nj->ni", vectors, part)
        coherence = np.where(high[:, 0] > 0, np.maximum(values[:, 0], 0) / np.where(high[:, 0] > 0, high[:, 0], 1.0), 0.0)
        left = np.einsum("ni,nij,nj->n", v, a, v) + 2 * np.einsum("ni,ni->n", v, b) + tt
        return np.column_stack([v, rank, coherence, np.sqrt(np.maximum(left, 0))])

    return solve


def velocities(sums: DataFrame, least: float = 0.05, total: bool = True) -> DataFrame:
    """sums of flow_sums() with vx, vy, vz (velocity along the axes), rank, coherence and residual, solved for all rows of a batch together.

    The velocity makes a pattern's change along its path vanish: derivative over the lag + velocity * gradient = 0, in the least-squares
    sense, or with total in the total least-squares sense. Directions whose eigenvalue is at most least times the largest carry no
    velocity; rank counts the others. coherence: smallest to largest eigenvalue; residual: root of what is left of the sum of squares.
    """
    solved: Column = K.by_batch(_solved(least, total), F.array(*PRODUCTS))
    rows = sums.withColumn("_v", solved)
    names = ("vx", "vy", "vz", "rank", "coherence", "residual")
    return rows.select(*sums.columns, *((F.get("_v", F.lit(i)).cast("int") if n == "rank" else F.get("_v", F.lit(i))).alias(n) for i, n in enumerate(names)))
