"""Optical flow: sums against loops, a moving pattern's velocity, and total against plain least squares."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from lagmill.operators import optical


def table(spark, corr):
    shape = corr.shape[:3]
    return spark.createDataFrame([(i, *p, corr[p].tolist()) for i, p in enumerate(product(*map(range, shape)))], "id long, x int, y int, z int, corr array<double>")


def test_sums_match_loops(spark):
    rng, sizes, step = np.random.default_rng(1), (1.0, 2.0, 1.5), 0.5
    corr = rng.normal(size=(3, 4, 2, 6))
    d = []
    for a in range(3):
        up, down = (np.take(corr, np.clip(np.arange(corr.shape[a]) + s, 0, corr.shape[a] - 1), a) for s in (1, -1))
        d.append((up - down) / (2 * sizes[a]))
    d.append((corr[..., np.clip(np.arange(6) + 1, 0, 5)] - corr[..., np.clip(np.arange(6) - 1, 0, 5)]) / (2 * step))
    own = {p: (np.maximum(corr, 0) * d["xyzt".index(p[0])] * d["xyzt".index(p[1])]).sum(-1) for p in optical.PRODUCTS}
    got = {(r.x, r.y, r.z): r for r in optical.flow_sums(table(spark, corr), sizes, step, 2.0).collect()}
    assert len(got) == 24
    for p, r in got.items():
        for name in optical.PRODUCTS:
            want = 0.0
            for q in product(range(3), range(4), range(2)):
                away = np.sqrt(sum(((a - b) * s) ** 2 for a, b, s in zip(p, q, sizes, strict=True)))
                want += np.exp(-0.5 * (away / 1.0) ** 2) * own[name][q] if away <= 2.0 else 0.0
            assert r[name] == pytest.approx(want)


def test_a_moving_pattern(spark):
    """Bumps that reach a place the later, the farther along: velocity is one over the delay's gradient. Rank tells how many directions a pattern has."""
    x, y, z, t = np.meshgrid(np.arange(10), np.arange(10), np.arange(4), np.arange(80), indexing="ij")
    wave = np.exp(-0.5 * ((t - 24 - x - 2 * y) / 9.0) ** 2)
    rows = optical.velocities(optical.flow_sums(table(spark, wave), radius=2.0)).collect()
    inner = [r for r in rows if 2 <= r.x <= 6 and 2 <= r.y <= 5]
    for r in inner:
        assert r["rank"] == 1 and (r.vx, r.vy, r.vz) == (pytest.approx(0.2, abs=0.02), pytest.approx(0.4, abs=0.04), pytest.approx(0, abs=1e-6)) and r.coherence < 0.05
    flat = optical.velocities(optical.flow_sums(table(spark, np.zeros((3, 3, 3, 8))))).collect()
    assert all((r.vx, r.vy, r.vz, r["rank"], r.residual) == (0, 0, 0, 0, 0) for r in flat)
    assert optical.velocities(optical.flow_sums(table(spark, wave).limit(0))).count() == 0


def test_total_least_squares_of_noisy_derivatives():
    rng, true = np.random.default_rng(5), np.array([0.7, -0.4, 0.2])
    g = rng.normal(size=(4000, 3))
    rate = -g @ true + 0.4 * rng.normal(size=4000)
    g = g + 0.4 * rng.normal(size=g.shape)
    d = np.column_stack([g, rate])
    sums = np.array([[d[:, "xyzt".index(p[0])] @ d[:, "xyzt".index(p[1])] for p in optical.PRODUCTS]])
    plain, total = (optical._solved(0.0, k)(sums)[0] for k in (False, True))
    assert plain[:3] == pytest.approx(np.linalg.lstsq(g, -rate, rcond=None)[0])
    smallest = np.linalg.eigh(d.T @ d)[1][:, 0]
    assert total[:3] == pytest.approx(smallest[:3] / smallest[3])
    assert np.linalg.norm(total[:3] - true) < 0.05 < np.linalg.norm(plain[:3] - true)
