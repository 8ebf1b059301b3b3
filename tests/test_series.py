"""Column builders over arrays against numpy, and operators on odd inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagmill.functions import kernels as K
from lagmill.functions import series as S
from lagmill.operators import frames, grids, lags, passes, quantiles

CASES = [[1.0, 5.0, 2.0, 8.0, 3.0], [2.0, 2.0, 2.0, 2.0], [0.0, -1.0, 4.0, 4.0, 9.0, -3.0], (np.sin(np.arange(31) / 3) + 2).tolist()]


def column(spark, expr):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "series_id int, values array<double>")
    return [r[0] for r in df.select(expr.alias("o"), "series_id").orderBy("series_id").collect()]


def test_statistics(spark):
    v = F.col("values")
    for f, g in ((S.mean, np.mean), (S.std_pop, np.std), (S.median, np.median), (S.mad, lambda x: np.median(np.abs(x - np.median(x))) / 0.6744897501960817)):
        assert column(spark, f(v)) == pytest.approx([g(np.array(c)) for c in CASES])


def test_normalisation(spark):
    v = F.col("values")
    for method in ("None", "percent", "variance", "z", "p2p", "mad"):
        for got, c in zip(column(spark, S.normalize(v, method)), CASES, strict=True):
            x = np.array(c)
            center = np.median(x) if method == "mad" else x.mean()
            spread = {"None": 1, "percent": 1, "variance": x.var(), "z": x.std(), "p2p": np.ptp(x), "mad": np.median(np.abs(x - np.median(x))) / 0.6744897501960817}[method]
            want = (x / x.mean() - 1 if x.mean() > 0 else x) if method == "percent" else (x - center) / (spread if spread > 0 else 1)
            assert got == pytest.approx(want, abs=1e-12), method


def test_shapes_and_windows(spark):
    v = F.col("values")
    for got, c in zip(column(spark, S.gradient(v)), CASES, strict=True):
        assert got == pytest.approx(np.gradient(c))
    for got, c in zip(column(spark, S.moving_average(v, 3)), CASES, strict=True):
        assert got == pytest.approx(np.convolve(c, np.ones(3) / 3, "same"))
    for kind, mode in (("reflect", "symmetric"), ("zero", "constant"), ("cyclic", "wrap"), ("constant", "edge")):
        for got, c in zip(column(spark, S.pad(v, 2, kind)), CASES, strict=True):
            assert got == pytest.approx(np.pad(c, 2, mode))
    got = column(spark, S.taper(F.size(v), "hann"))[0]
    assert got == pytest.approx(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(5) / 5))
    for got, c in zip(column(spark, S.detrend(v)), CASES, strict=True):
        assert got == pytest.approx(K.poly_detrend(1)(np.array(c)[None])[0], abs=1e-9)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), float(x)) for k, x in zip(rng.integers(0, 3, 5000), np.round(rng.exponential(size=5000) ** 3, 2), strict=True)] + [(7, 1.0), (8, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    by = {k: np.sort([v for q, v in rows if q == k and v is not None]) for k in (0, 1, 2, 7)}
    got = {r.k: r.m for r in quantiles.medians(df, ["k"], "v", "m").collect()}
    assert got == pytest.approx({k: np.median(x) for k, x in by.items()})
    fractions = [0.0, 0.1, 0.5, 1.0]
    for r in quantiles.nearest_rank(df, ["k"], "v", fractions).collect():
        x = by[r.k]
        assert r.v == x[min(int(np.round(r.fraction * len(x))), len(x) - 1)]
    ranked = quantiles.percentile_rank(df.where("v is not null"), "v", "p").collect()
    values = np.unique([v for _, v in rows if v is not None])
    assert all(r.p == pytest.approx(100 * np.searchsorted(values, r.v) / 5000) for r in ranked)
    assert quantiles.medians(df.limit(0), ["k"], "v", "m").count() == 0


def test_known_lag_is_found(spark):
    rng = np.random.default_rng(3)
    base = np.convolve(rng.normal(size=300), np.ones(5) / 5, "same")
    rows = [(i, [float(x) for x in base[100 - d : 200 - d] + 0.05 * rng.normal(size=100)]) for i, d in enumerate([0, 3, -4, 7, 0, 0, 0])]
    series = spark.createDataFrame(rows, "series_id int, values array<double>")
    ref = spark.createDataFrame([([float(x) for x in base[100:200]],)], "ref array<double>")
    for window in (None, "hamming"):
        got = {r.series_id: r for r in lags.best_lags(lags.correlograms(series, ref, 10, window), 10).collect()}
        assert [got[i].lag for i in range(4)] == [0, 3, -4, 7] and min(r.strength for r in got.values()) > 0.8
    fits, _, ran = passes.lag_passes(series, 10, passes=2, window=None)
    lag = {r.series_id: r.lag for r in fits.collect()}
    assert [round(lag[i] - lag[0]) for i in range(4)] == [0, 3, -4, 7] and 1 <= ran <= 2
    left = passes.filtered(series, lags.best_lags(lags.correlograms(series, ref, 10), 10).withColumn("fail", F.lit(0)), ref)
    assert all(r.r2 > 0.9 for r in left.collect())


def test_bad_points_follow_a_loop(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for i in range(60):
        bad = rng.random(25) < 0.15
        filled, last, was = bad.copy(), 0, bool(bad[0])
        for t in range(1, 25):
            if bad[t]:
                if not was and t - last < 4:
                    filled[last:t] = True
                last, was = t, True
            else:
                was = False
        if 25 - last - 1 < 4:
            filled[last:] = True
        want[i] = filled.tolist()
        rows += [(i, t, bool(b)) for t, b in enumerate(bad)]
    df = spark.createDataFrame(rows, "series_id int, t int, bad boolean")
    got = {i: [None] * 25 for i in want}
    for r in frames.bad_points(df, 4).collect():
        got[r.series_id][r.t] = r.filled
    assert got == want


def test_components_on_a_grid(spark):
    rng = np.random.default_rng(6)
    cells = [(int(x + 12 * y), int(x), int(y), 0) for x in range(12) for y in range(12) if rng.random() < 0.55]
    ids = {c[1:3]: c[0] for c in cells}
    want, left = {}, dict(ids)
    for start in sorted(left, key=left.get):
        if ids[start] in want:
            continue
        stack = [start]
        while stack:
            x, y = stack.pop()
            if ids.get((x, y)) is not None and ids[x, y] not in want:
                want[ids[x, y]] = ids[start]
                stack += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
    df = spark.createDataFrame(cells, "id int, x int, y int, z int")
    assert {r.id: r.component for r in grids.components(df, "id").collect()} == want


def test_step_fill(spark):
    ticks = spark.createDataFrame([("a", t) for t in range(6)], "series_id string, t int")
    steps = spark.createDataFrame([("a", 1, 5.0), ("a", 4, 7.0), ("b", 0, 1.0)], "series_id string, t int, value double")
    assert [r.value for r in frames.step_fill(ticks, steps).orderBy("t").collect()] == [None, 5.0, 5.0, 5.0, 7.0, 7.0]
