"""Flooding, flow accumulation and small delays against brute force and known shifts."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagmill.functions import kernels as K
from lagmill.functions import series as S
from lagmill.operators import delays, flow


def grid(spark, values, seeds=None):
    rows = [(i, *map(int, p), None if np.isnan(values[p]) else float(values[p]), 1.0 if seeds is None else float(seeds[p])) for i, p in enumerate(np.ndindex(values.shape))]
    return spark.createDataFrame(rows, "id long, x int, y int, z int, a double, seed double")


def around(p, shape):
    for d in product((-1, 0, 1), repeat=3):
        q = tuple(np.add(p, d))
        if any(d) and all(0 <= k < n for k, n in zip(q, shape, strict=True)):
            yield q, float(np.sqrt(np.dot(d, d)))


@pytest.mark.parametrize("epsilon", [0.0, 0.25])
def test_flood_against_relaxation(spark, epsilon):
    v = np.random.default_rng(1).random((5, 5, 5))
    level = np.where([[[any(k in (0, 4) for k in (x, y, z)) for z in range(5)] for y in range(5)] for x in range(5)], v, np.inf)
    inner = [p for p in np.ndindex(v.shape) if np.isinf(level[p])]
    for _ in range(30):
        for p in inner:
            level[p] = max(v[p], min(level[q] for q, _ in around(p, v.shape)) + epsilon)
    got = {r.id: r.filled for r in flow.filled(grid(spark, v), "a", epsilon).collect()}
    assert got == pytest.approx(dict(enumerate(level.ravel())))


def test_flood_of_a_basin_nulls_and_nothing(spark):
    v = np.ones((5, 5, 5))
    v[2, 2, 2] = 0.2
    assert {r.filled for r in flow.filled(grid(spark, v), "a").collect()} == {1.0}
    v[0, 0, 0] = np.nan
    got = {r.id: r.filled for r in flow.filled(grid(spark, v), "a").collect()}
    assert got[0] is None and len(got) == 125
    assert flow.filled(grid(spark, v).limit(0), "a").count() == 0


def test_accumulation_against_a_loop(spark):
    rng = np.random.default_rng(2)
    v, seed = np.round(rng.random((4, 4, 4)), 1), rng.random((4, 4, 4))  # with ties
    load = seed.copy()
    for i in np.argsort(v.ravel(), kind="stable"):
        p = np.unravel_index(i, v.shape)
        up = [(q, ((v[q] - v[p]) / d) ** 1.1) for q, d in around(p, v.shape) if v[q] > v[p]]
        for q, w in up:
            load[q] += load[p] * w / sum(w for _, w in up)
    got = {r.id: r.load for r in flow.accumulated(grid(spark, v, seed), "a", "seed").collect()}
    assert got == pytest.approx(dict(enumerate(load.ravel())))
    assert flow.accumulated(grid(spark, v).limit(0), "a", "seed").count() == 0


def test_roots():
    rng = np.random.default_rng(3)
    c = np.vstack([rng.normal(size=(50, 4)), [[0.5, 0, 0, 0], [0, 0, 0, 0], [0, 1, 0, 0]]])
    got = K.nearest_root(-2.0, 2.0)(c)
    for row, x in zip(c, got, strict=True):
        found = np.roots([*row[::-1], 1.0])
        real = [r.real for r in found if abs(r.imag) < 1e-9 and abs(r.real) <= 2 + 1e-9]
        assert x == pytest.approx(min(real, key=abs) if real else 0.0, abs=1e-6)


def test_known_delays_are_found(spark):
    t = np.arange(200)
    ref = np.sin(0.31 * t) + np.sin(0.13 * t + 1) + 0.3 * np.sin(0.47 * t)
    shifts = np.array([-0.6, -0.2, 0.0, 0.33, 0.7])
    moved = K.shifted(np.repeat(ref[None], 5, axis=0), shifts)
    one = spark.createDataFrame([(ref.tolist(),)], "ref array<double>")
    rows = spark.createDataFrame([(i, (3 * m + 1).tolist()) for i, m in enumerate(moved)], "series_id int, values array<double>")
    table = delays.trained(one, 0.75, 0.05)
    got = delays.slope_ratios(rows, one).crossJoin(table).select("series_id", delays.delay_of(F.col("ratio"), F.col("lookup")).alias("d")).orderBy("series_id").collect()
    assert [r.d for r in got] == pytest.approx(list(shifts), abs=1e-3)
    ends = spark.createDataFrame([(-1e9,), (1e9,), (None,)], "ratio double").crossJoin(table)
    low, high, none = (r.d for r in ends.select(delays.delay_of(F.col("ratio"), F.col("lookup")).alias("d")).collect())
    assert (low, high) == pytest.approx((0.75, -0.75)) and none is None


def test_patch_replaces_a_spike_only(spark):
    v = np.add.outer(np.add.outer(np.arange(4.0), np.arange(4.0)), np.arange(4.0))
    v[1, 2, 1] = 90.0
    rows = delays.patched(grid(spark, v), "a", 3.0).collect()
    assert {r.id for r in rows if r.patched != r.a} == {1 * 16 + 2 * 4 + 1}


def test_flattened_outliers_and_prenorm(spark):
    y = 0.5 * np.arange(60) + np.tile([0.1, -0.1], 30)
    y[30] += 40
    out = spark.createDataFrame([(y.tolist(),)], "v array<double>").select(S.flatten_outliers(F.col("v"), 5.0).alias("v")).first().v
    b, a = np.polyfit(np.arange(60), y, 1)
    want = y.copy()
    want[30] = a + b * 30
    assert out == pytest.approx(want)
    row = spark.createDataFrame([([1.0, 3.0], 2.0, -0.5)], "v array<double>, lag double, r double")
    make = lambda n, w: delays.prenormalized(F.col("v"), F.col("lag"), F.col("r"), F.col("r") * F.col("r"), F.lit(True), n, w)
    got = row.select(make("mean", "R"), make("var", "R2"), make("invlag", ""), make("", "R")).first()
    assert [list(x) for x in got] == [[-0.25, -0.75], [0.25, 0.75], [-0.125, -0.375], [-0.5, -1.5]]
    assert row.select(make("mean", "R").alias("x"), delays.prenormalized(F.col("v"), F.lit(11.0), F.col("r"), F.col("r"), F.lit(True), "invlag").alias("y")).first().y == [0.0, 0.0]


def test_legacy_band_has_its_own_stops():
    f = np.linspace(0, 0.5, 1001)
    gain = K.transfer(f, 0.01, 0.15, "trapezoidal", stops=(0.009, 0.2))
    at = lambda x: float(np.interp(x, f, gain))
    assert at(0.175) == pytest.approx(0.5) and at(0.2) == pytest.approx(0) and at(0.1) == pytest.approx(1) and at(0.0085) == pytest.approx(0)
    x = np.sin(2 * np.pi * 0.175 * np.arange(400))[None]
    assert np.std(K.band_filter(1.0, "lfo_legacy")(x)[0, 100:300]) == pytest.approx(np.std(x) / 2, rel=0.05)
