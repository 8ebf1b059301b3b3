"""Kalman filters against loops over single series, and planted rates."""

from __future__ import annotations

import numpy as np
import pytest

from lagmill.operators import kalman

SCHEMA = "series_id int, values array<double>"


def loop(x, adaptive, q=1e-3, r=0.05):
    """One series, in plain numbers."""
    a = b = c = 0.0
    p = d = 1.0
    q_now, r_now, sizes, levels, marks = q, r, [], [], []
    for v in x:
        a, p, c, d = a + b, p + 2 * c + d + q_now / 4, c + d + q_now / 2, d + q_now
        mark = False
        if v is not None:
            e = v - a
            mark = adaptive and len(sizes) >= 10 and np.std(sizes[-10:]) > 0 and abs(e) > 3 * np.std(sizes[-10:])
            k, m = p / (p + r_now), c / (p + r_now)
            a, b, d, c, p = a + k * e, b + m * e, d - m * c, c - k * c, p - k * p
            sizes.append(abs(e))
            if adaptive:
                r_now = 10 * r if mark else r
                if len(sizes) >= 30:
                    q_now = min(max(np.std(sizes[-30:]) * 0.05, 1e-4), 1e-2)
        levels.append(a)
        marks.append(bool(mark))
    return levels, marks


@pytest.mark.parametrize("adaptive", [False, True])
def test_velocity_filters_equal_a_loop(spark, adaptive):
    g = np.random.default_rng(1)
    data = [[float(v) for v in np.sin(np.arange(90) / 7 + i) + 0.1 * g.normal(size=90)] for i in range(5)]
    data[1][40] += 9.0
    for i in (3, 4, 50, 51, 52):
        data[2][i] = None
    data[3] = data[3][:20]
    data[4] = [2.0] * 90
    rows = kalman.velocity_filtered(spark.createDataFrame(list(enumerate(data)), SCHEMA), 1.0, adaptive=adaptive).collect()
    for r in rows:
        levels, marks = loop(data[r.series_id], adaptive)
        assert r.filtered == pytest.approx(levels, abs=1e-9) and list(r.motion) == marks
    if adaptive:
        assert {r.series_id: r.motion for r in rows}[1][40]


def test_null_empty_and_missing_series(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [None, None, None])], SCHEMA)
    for got in (kalman.velocity_filtered(df, 1.0, adaptive=True), kalman.harmonic_filtered(df, 0.1, 1.0, harmonics=2)):
        rows = {r.series_id: r.filtered for r in got.collect()}
        assert rows[0] is None and rows[1] is None and len(rows[2]) == 3
    assert kalman.velocity_filtered(df.limit(0), 1.0).count() == 0


@pytest.mark.parametrize("harmonics", [1, 2, 3])
def test_planted_rates_are_found_across_a_gap(spark, harmonics):
    t = np.arange(3000) * 0.02
    data = []
    for rate in (1.15, 1.25):
        angle = 2 * np.pi * rate * t
        x = 0.3 + np.sin(angle) + (0.3 * np.sin(2 * angle) if harmonics > 1 else 0)
        data.append([None if 1500 <= i < 1520 else float(v) for i, v in enumerate(x)])
    rows = kalman.harmonic_filtered(spark.createDataFrame(list(enumerate(data)), SCHEMA), 0.02, 1.2, harmonics=harmonics).orderBy("series_id").collect()
    for r, rate in zip(rows, (1.15, 1.25), strict=True):
        assert np.mean(r.rate[-500:]) == pytest.approx(rate, abs=0.02)
        assert len(r.amplitudes) == harmonics and all(len(a) == 3000 for a in r.amplitudes)
        truth = np.array([np.nan if v is None else v for v in data[r.series_id]])
        assert np.nanmean(np.abs(truth - np.array(r.filtered))[-500:]) < 0.1


def test_harmonic_filter_equals_a_loop_with_full_matrices(spark):
    g = np.random.default_rng(2)
    x = [float(v) for v in np.sin(np.arange(60) * 0.7) + 0.2 * g.normal(size=60)]
    x[20] = None
    r = kalman.harmonic_filtered(spark.createDataFrame([(0, x)], SCHEMA), 0.1, 1.1, 1e-3, 0.5, 3).first()
    s = np.array([0, 1.0, 0.2, 0.1, 0, 2 * np.pi * 1.1])
    p, q = 0.1 * np.eye(6), np.diag([1e-4, 1e-3, 5e-4, 5e-4, 2e-3, 1e-4])
    f = np.eye(6)
    f[4, 5] = 0.1
    expect = lambda s: s[0] + sum(s[k] * np.sin(k * s[4]) for k in (1, 2, 3))
    for i, v in enumerate(x):
        s, p = f @ s, f @ p @ f.T + q
        if v is not None:
            small = 1e-6  # derivatives by differences, apart from the closed form of the operator
            h = np.array([(expect(s + small * e) - expect(s - small * e)) / (2 * small) for e in np.eye(6)])
            gain = p @ h / (h @ p @ h + 0.5)
            s, p = s + gain * (v - expect(s)), (np.eye(6) - np.outer(gain, h)) @ p
        assert r.filtered[i] == pytest.approx(expect(s), abs=1e-6) and r.rate[i] == pytest.approx(s[5] / (2 * np.pi), abs=1e-6)
