"""Peak fits against brute force, and masks and graphs on small cases."""

from __future__ import annotations

import numpy as np
import pytest

from lagmill.operators import fits, graphs, masks


def test_gaussian_fit_against_a_grid():
    """The least-squares Gaussian of a peak with noise beats every point of a fine grid around it."""
    g = np.random.default_rng(1)
    x = np.arange(-10.0, 11.0)
    c = np.stack([0.8 * np.exp(-((x - m) ** 2) / (2 * s * s)) for m, s in ((1.3, 2.0), (-3.2, 1.5), (0.0, 3.0))]) + 0.01 * g.normal(size=(3, 21))
    got = fits.peak_fits("gauss", 1.0, (-10, 10))(c)
    assert np.abs(got[:, 0] - [1.3, -3.2, 0.0]).max() < 0.1 and np.abs(got[:, 1] - 0.8).max() < 0.03 and not got[:, 3].any()
    for row, (lag, high, wide, _) in zip(c, got, strict=True):
        k = row[1:-1].argmax() + 1
        use = (row > row[k] / 2) & (np.abs(np.arange(21) - k) < 6)
        cost = lambda a, m, s: ((row - a * np.exp(-((x - m) ** 2) / (2 * s * s)))[use] ** 2).sum()  # noqa: B023, E731
        around = [cost(high + a, lag + m, wide + s) for a in (-0.02, 0, 0.02) for m in (-0.05, 0, 0.05) for s in (-0.05, 0, 0.05)]
        assert cost(high, lag, wide) <= min(around) + 1e-9


def test_every_kind_finds_a_clean_peak_and_flags_bad_ones():
    x = np.arange(-10.0, 11.0)
    clean = 0.7 * np.exp(-((x - 2) ** 2) / (2 * 2.5**2))[None]
    for kind in fits.KINDS:
        lag, high, wide, flags = fits.peak_fits(kind, 1.0, (-10, 10))(clean)[0]
        assert lag == pytest.approx(2, abs=0.2) and high == pytest.approx(0.7, abs=0.02) and flags == 0, kind
    flags = lambda c, **k: int(fits.peak_fits("fastquad", 1.0, **{"lag_range": (-10, 10), **k})(np.asarray(c)[None])[0, 3])
    assert flags(-1 - 0.01 * x**2) & fits.FLAGS["init_amp_low"] and flags(-1 - 0.01 * x**2) & fits.FLAGS["fit_amp_low"]
    assert flags(clean[0], lag_range=(-10, 1)) == fits.FLAGS["fit_lag_high"]
    assert flags(3 * clean[0]) & fits.FLAGS["init_amp_high"] and flags(3 * clean[0]) & fits.FLAGS["fit_amp_high"]
    assert not fits.peak_fits("fastquad", 1.0, (-10, 1), zero_bad=True)(clean)[0, :3].any()
    with pytest.raises(ValueError):
        fits.peak_fits("cubic", 1.0, (-1, 1))


def test_roots_and_components(spark):
    rng = np.random.default_rng(2)
    parent = {i: (i if i == 0 or rng.random() < 0.02 else int(rng.integers(0, i))) for i in range(400)} | {1000 + i: 1000 + max(0, i - 1) for i in range(150)}
    got = {r.id: r.root for r in graphs.roots(spark.createDataFrame(list(parent.items()), "id long, parent long")).collect()}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    assert got == {i: top(i) for i in parent}
    edges = spark.createDataFrame([(i, p) for i, p in parent.items() if i != p], "a long, b long")
    found = {r.id: r.component for r in graphs.components(edges, "a", "b").collect()}
    assert found == {i: min(j for j in parent if top(j) == top(i)) for i in found}


def test_masks_on_small_cases(spark):
    series = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 1.0, 1.0]), (3, [1.0, float("nan"), 2.0]), (4, [])], "series_id long, values array<double>")
    assert [r.series_id for r in masks.valid_series(series).collect()] == [1]
    cut = lambda a, b: [r["values"] for r in masks.between_times(series.where("series_id = 1"), a, b).collect()][0]
    assert cut(1, -1) == [2.0, 3.0] and cut(0, 1) == [1.0, 2.0] and cut(5, 9) == [3.0] and cut(-1, 0) == [1.0]
    line = spark.createDataFrame([(i, i, 0, 0) for i in (0, 1, 2, 5, 6, 9)], "id long, x int, y int, z int")
    assert {(r.id, r.cluster, r.size) for r in masks.clusters(line, "id", 2).collect()} == {(0, 1, 3), (1, 1, 3), (2, 1, 3), (5, 2, 2), (6, 2, 2)}
    assert {r.id for r in masks.grown(line, "id", line["id"] == 6).collect()} == {5, 6}
    box = masks.bounding_box(line, 1).first()
    assert (box.x_low, box.x_high, box.y_low, box.n) == (-1, 10, -1, 6)
