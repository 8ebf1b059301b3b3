"""Composed lag passes against planted lags and brute-force references."""

from __future__ import annotations

import numpy as np
import pytest

from lagmill.functions import kernels as K
from lagmill.operators import fits, grids, refinement
from lagmill.sources import tables

N, SIDE = 160, 4
CELLS = [(i, i % SIDE, i // SIDE % SIDE, i // SIDE**2) for i in range(SIDE**3)]


def planted(seed=0, noise=0.4):
    g = np.random.default_rng(seed)
    wave = np.convolve(g.normal(size=N + 60), np.hanning(9), "valid")
    truth = np.array([x + y - z for _, x, y, z in CELLS])
    x = np.stack([wave[20 - lag : 20 - lag + N] for lag in truth])
    return truth, x / x.std() + noise * g.normal(size=x.shape)


def frames(spark, x):
    series = spark.createDataFrame([(i, None if row is None else [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)], "series_id int, values array<double>")
    return series, spark.createDataFrame(CELLS, "series_id int, x int, y int, z int")


@pytest.mark.parametrize("components", [None, 2])
def test_passes_find_planted_lags_and_leave_no_tables_but_the_last(spark, components):
    truth, x = planted()
    series, cells = frames(spark, x)
    before = len(tables._written)
    peaks = refinement.Peaks(10)
    found = refinement.composed_passes(series, peaks, cells, repeats=500, components=components)
    rows = {r.series_id: r for r in found.fits.collect()}
    off = np.array([rows[i].lag for i in range(len(truth))]) - truth
    assert np.abs(off - np.median(off)).max() < 0.6 and all(r.flags == 0 for r in rows.values())
    assert 0.05 < found.least < 0.6 and 1 < found.passes <= 3
    assert len(tables._written) == before + 1
    left = {r.series_id: r for r in refinement.regressed(series, found, peaks).collect()}
    for i, v in left.items():
        ref = K.shifted(K.standardized(found.ref[None, :]), np.array([v.lag]))[0]
        assert abs(np.corrcoef(v.filtered, ref)[0, 1]) < 1e-6 and np.std(v.filtered) < 0.75 * x[i].std() and v.r > 0.5


def test_speckles_are_fitted_again_near_their_neighbours(spark):
    truth, x = planted(1, 0.05)
    decoys = [5, 21, 42]
    for i in decoys:  # a stronger copy far away from its place
        x[i] = 0.7 * x[i] + 1.1 * np.roll(x[i], 9 if truth[i] < 0 else -9)
    series, cells = frames(spark, x)
    ref = x[0]
    peaks = refinement.Peaks(14)
    plain = refinement.lag_fits(series, ref, peaks)
    first = {r.series_id: r.lag for r in plain.collect()}
    assert all(abs(first[i] - truth[i]) > 5 for i in decoys)
    got = {r.series_id: r for r in refinement.despeckled(series, cells, plain, ref, peaks, 3.0).collect()}
    assert all(abs(r.lag - truth[i]) < (2 if i in decoys else 1) for i, r in got.items())  # the copies' side lobes move the decoys' peaks
    assert {i for i, r in got.items() if r.refit} == set(decoys)


@pytest.mark.parametrize(("weight", "components"), [("R", None), ("R2", None), ("None", 3)])
def test_rebuilt_reference_equals_brute_force(spark, weight, components):
    truth, x = planted(2)
    series, _ = frames(spark, x)
    ref, peaks = x.mean(axis=0), refinement.Peaks(10)
    f = fits.peak_fits("fastgauss", 1.0, (-10, 10))(peaks.correlated(x, ref))
    use = (f[:, 3] == 0) & (f[:, 1] >= 0.5)
    moved = K.shifted(K.standardized(x[use]), -f[use, 0])
    w = {"R": f[use, 1], "R2": f[use, 1] ** 2, "None": np.ones(use.sum())}[weight]
    want = w @ moved / w.sum()
    if components:
        u = np.linalg.svd(moved, full_matrices=False)[2][:components]
        want = u.T @ (u @ want)
    got = refinement.rebuilt_reference(series, ref, peaks, None, 0.5, weight, components)
    assert got == pytest.approx(want, abs=1e-8)
    assert refinement.rebuilt_reference(series, ref, peaks, None, 1.1, weight, components) is None


def test_missing_samples_other_lengths_and_null_series_take_no_part(spark):
    _, x = planted(3)
    whole = refinement.rebuilt_reference(frames(spark, x)[0], x[0], refinement.Peaks(10), None, 0.3)
    holes = x[1].copy()
    holes[7] = np.nan
    odd = [*x, holes, x[2][:50], None, [], np.ones(N)]
    series, _ = frames(spark, odd)
    assert refinement.rebuilt_reference(series, x[0], refinement.Peaks(10), None, 0.3) == pytest.approx(whole)
    rows = {r.series_id: r for r in refinement.lag_fits(series, x[0], refinement.Peaks(10)).collect()}
    n = len(x)
    assert rows[n].flags == rows[n + 1].flags == fits.FLAGS["fit_algorithm"] and rows[n + 2].flags is None and rows[n + 3].lag is None
    with pytest.raises(ValueError):
        refinement.composed_passes(series.limit(0), refinement.Peaks(10))


def test_threshold_is_the_nearest_rank_of_surrogates(spark):
    _, x = planted(4)
    peaks = refinement.Peaks(10)
    got = refinement.null_threshold(spark, x[0], peaks, 0.9, 200)
    strengths = np.sort(peaks.kernel(x[0])(K.surrogate(np.arange(200), x[0], "shuffle"))[:, 1])
    assert got == pytest.approx(strengths[180]) and got == refinement.null_threshold(spark, x[0], peaks, 0.9, 200)


def test_tables_that_grow_with_the_series_are_not_sent_to_all_tasks(spark):
    """Those of few rows are; before, every table of small files was."""
    series, cells = frames(spark, planted(4)[1])
    ref, peaks = np.arange(N, dtype=float), refinement.Peaks(10)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for count, sent in ((100, True), (20_001, False)):
        moved = tables.materialize(spark.range(count).selectExpr("int(id) AS series_id", "1d AS lag", "1d AS strength", "1d AS width", "0 AS flags"), "moved")
        rows = refinement.placed(series, ref, peaks, moved, lambda x, lag: x, "values")
        assert ("BroadcastHashJoin" in plan(rows)) == sent
        tables.discard(moved)
    written = tables.materialize(cells, "cells")
    assert "Broadcast" not in plan(grids.neighbors(written, 1.75))
    tables.discard(written)


def test_fits_do_not_depend_on_what_is_sent(spark, monkeypatch):
    _, x = planted(1, 0.05)
    for i in (5, 21, 42):
        x[i] = 0.7 * x[i] + 1.1 * np.roll(x[i], -9)
    series, cells = frames(spark, x)
    peaks, found = refinement.Peaks(14), []
    for most in (20_000, 0):
        monkeypatch.setattr(refinement, "MOST_SENT", most)
        fits_ = refinement.despeckled(series, cells, refinement.lag_fits(series, x[0], peaks), x[0], peaks, 3.0)
        moved = fits_.where("refit").select("series_id", *refinement.FIT)
        rows = refinement.placed(series, x[0], peaks, moved, lambda v, lag: lag[:, None], "values")
        found.append(sorted(map(str, fits_.collect())) + sorted(map(str, rows.collect())))
    assert found[0] == found[1] and "refit=True" in "".join(found[0])
