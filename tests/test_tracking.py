"""Frequency tracking against all paths, a planted chirp and a wave that comes out again."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from lagmill.operators import tracking

SCHEMA = "series_id int, values array<double>, extra string"


def frame(spark, x):
    return spark.createDataFrame([(i, None if row is None else [float(v) for v in row], "e") for i, row in enumerate(x)], SCHEMA)


@pytest.mark.parametrize("stiffness", [0.0, 0.4, 5.0])
def test_ridge_is_the_best_of_all_paths(stiffness):
    g = np.random.default_rng(3)
    gain = g.normal(size=(6, 6, 4))
    value = lambda row, path: sum(gain[row, t, k] for t, k in enumerate(path)) - stiffness * sum(abs(a - b) for a, b in zip(path, path[1:], strict=False))
    got = tracking.ridge(gain, stiffness)
    for row in range(6):
        assert value(row, got[row]) == pytest.approx(max(value(row, p) for p in product(range(4), repeat=6)))


def test_ties_take_the_lower_line():
    assert tracking.ridge(np.zeros((1, 5, 3)), 1.0).tolist() == [[0] * 5]


def test_chirp_is_followed_through_a_louder_burst(spark):
    n = 600
    t = np.arange(n)
    truth = 0.08 + 0.12 * t / n
    x = np.sin(2 * np.pi * np.cumsum(truth)) + 0.2 * np.random.default_rng(4).normal(size=n)
    x[295:305] += 8 * np.sin(2 * np.pi * 0.35 * t[295:305])
    rows = frame(spark, [x])
    stiff = tracking.tracked(rows, 1.0, 0.05, 0.45, 64, 2.0).first()
    loose = tracking.tracked(rows, 1.0, 0.05, 0.45, 64, 0.0).first()
    inner = slice(40, n - 40)
    assert np.abs(np.array(stiff.frequency)[inner] - truth[inner]).max() < 0.025
    assert np.abs(np.array(loose.frequency)[inner] - truth[inner]).max() > 0.1
    assert stiff.extra == "e" and len(stiff.share) == n


def test_rows_in_blocks_give_the_same(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(7, 50))
    whole = tracking.ridge_kernel(1.0, 0.1, 0.4, 16, 1.0, 0.0)(x)
    monkeypatch.setattr(tracking, "BLOCK", 100)
    assert np.array_equal(whole, tracking.ridge_kernel(1.0, 0.1, 0.4, 16, 1.0, 0.0)(x))


def test_cleaning_takes_the_wave_and_its_harmonics_and_leaves_the_rest(spark):
    t = np.arange(400)
    slow = np.sin(2 * np.pi * 0.01 * t)
    wave = np.sin(2 * np.pi * 0.1 * t + 0.3) + 0.5 * np.sin(2 * np.pi * 0.2 * t)
    rows = tracking.tracked(frame(spark, [2 * wave + slow, slow]), 1.0, 0.08, 0.15, 64, 1.0)
    first, second = tracking.cleaned(rows, 1.0, 64, 1).orderBy("series_id").collect()
    inner = slice(70, 330)
    before, after = (np.abs(np.array(v) - slow)[inner].mean() for v in (first["values"], first.cleaned))
    assert after < 0.15 * before
    assert np.abs(np.array(second.cleaned) - slow)[inner].mean() < 0.2


def test_constant_short_empty_and_null_series(spark):
    rows = tracking.tracked(frame(spark, [[0.0] * 20, [1.0], [], None]), 1.0, 0.1, 0.4, 16, least=0.5)
    got = {r.series_id: r for r in tracking.cleaned(rows, 1.0, 16).collect()}
    assert list(got[0].frequency) == [0.0] * 20 and list(got[0].cleaned) == [0.0] * 20
    assert len(got[1].frequency) == 1
    assert got[2].frequency is None and got[3].cleaned is None
    with pytest.raises(ValueError):
        tracking.ridge_kernel(1.0, 0.41, 0.42, 16, 1.0, 0.0)
