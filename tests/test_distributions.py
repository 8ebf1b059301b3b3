"""Bounded fits, significance, complex components and aliased correlation against planted truths and numpy."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagmill.operators import decomposition, distributions, lags, quantiles


def test_fit_of_planted_distributions(spark):
    rng, rows, true = np.random.default_rng(2), [], {"a": (0.8, 1.2, -0.2, 1.5), "b": (-0.5, 0.9, 0.0, 1.0)}
    for key, (gamma, delta, xi, lam) in true.items():
        z = rng.permutation([NormalDist().inv_cdf((k + 0.5) / 20_000) for k in range(20_000)])
        rows += [(key, float(xi + lam / (1 + np.exp(-(v - gamma) / delta)))) for v in z]
    rows += [("heavy", float(v)) for v in rng.standard_cauchy(3000)] + [("ties", 1.0)] * 3000 + [("a", None)]
    values = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in distributions.johnson_fits(values, ["k"], "v").collect()}
    for key, want in true.items():
        assert (got[key].gamma, got[key].delta, got[key].xi, got[key].lam) == pytest.approx(want, abs=0.01)
    assert got["heavy"].lam is None and got["ties"].lam is None
    side = {(r.k, r.share): r for r in distributions.thresholds(values, ["k"], "v", [0.9, 0.99]).collect()}
    assert all(side[k, s].from_fit == pytest.approx(side[k, s].from_data, abs=0.003) for k in true for s in (0.9, 0.99))
    fits = distributions.johnson_fits(values, ["k"], "v")
    gamma, delta, xi, lam = true["a"]
    asked = spark.createDataFrame([("a", float(xi + lam / (1 + np.exp(-(NormalDist().inv_cdf(1 - p) - gamma) / delta)))) for p in (0.01, 0.001, 0.003)] + [("a", -5.0), ("a", 9.0), ("heavy", 0.0)], "k string, v double")
    found = [r.neg_log_p for r in distributions.with_significance(asked, fits, ["k"], "v").orderBy("k", "v").collect()]
    assert found[0] == 0.0 and found[1:4] == pytest.approx([2, -np.log10(0.003), 3], abs=0.02) and found[4] == 4.0 and found[5] is None


def test_order_statistics_of_ties(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros(3000), np.round(rng.normal(size=2000), 1), [1e300]])
    values = spark.createDataFrame([(float(v),) for v in rng.permutation(x)], "v double")
    ranks = [0, 1, 700, 2500, 4999, 5000]
    got = {r["rank"]: r.v for r in quantiles.order_statistics(values, [], "v", F.array(*(F.lit(k).cast("long") for k in ranks))).collect()}
    assert got == {k: np.sort(x)[k] for k in ranks}


def test_complex_components(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(80, 3)) + 1j * rng.normal(size=(80, 3))) @ (rng.normal(size=(3, 6)) + 1j * rng.normal(size=(3, 6))) + 2 - 1j
    series = spark.createDataFrame([(i, v.real.tolist(), v.imag.tolist()) for i, v in enumerate(x)], "series_id long, re array<double>, im array<double>")
    components, variances, mean = decomposition.complex_components(series, 6, 3)
    _, s, _ = np.linalg.svd(x - x.mean(axis=0))
    assert variances == pytest.approx(s[:3] ** 2 / 80) and mean == pytest.approx(x.mean(axis=0))
    assert components @ components.conj().T == pytest.approx(np.eye(3), abs=1e-9)
    scores = decomposition.complex_scores(series, components, mean)
    back = {r.series_id: np.array(r.re) + 1j * np.array(r.im) for r in decomposition.complex_restored(scores, components, mean).collect()}
    assert np.array([back[i] for i in range(80)]) == pytest.approx(x)


def test_aliased_correlation_finds_the_delay(spark):
    rng, t = np.random.default_rng(5), np.arange(400)
    hi = np.convolve(rng.normal(size=420), np.ones(21) / 21, "valid")[:400]
    rows = [(k, np.roll(hi, 7)[k::4].tolist(), hi.tolist(), k) for k in range(4)] + [(9, [1.0], hi.tolist(), 0)]
    table = spark.createDataFrame(rows, "id long, lo array<double>, hi array<double>, offset int")
    got = {r.id: r.corr for r in lags.aliased_correlograms(table, "lo", "hi", 4, "offset", 20).collect()}
    assert got[9] is None and all(np.argmax(got[k]) - 20 == 7 for k in range(4)) and len(t) == 400
