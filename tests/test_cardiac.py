"""Slice waveforms against a loop and a planted heart beat."""

from __future__ import annotations

import numpy as np
import pytest

from lagmill.operators import cardiac


@pytest.mark.parametrize("scaled", [False, True])
def test_waveform_is_the_loops(spark, scaled):
    rng, n_steps, offset = np.random.default_rng(1), 5, [0, 3, 1, 3]
    x, w = rng.normal(size=(4, 6, 20)), rng.choice([0.0, 0.5, 2.0, -1.0], size=(4, 6))
    rows = [(s, float(w[s, i]), x[s, i].tolist()) for s in range(4) for i in range(6)] + [(0, None, x[0, 0].tolist()), (7, 1.0, x[0, 0].tolist())]
    series = spark.createDataFrame(rows, "slice int, weight double, values array<double>")
    offsets = spark.createDataFrame(list(enumerate(offset)), "slice int, offset int")
    want = np.zeros(100)
    for s in range(4):
        m = (x[s] * w[s][:, None])[w[s] != 0].mean(axis=0)
        if scaled:
            m = (m - np.median(m)) / (np.median(np.abs(m - np.median(m))) / 0.6744897501960817)
        want[offset[s] :: n_steps] -= m
    cycle = want.reshape(20, 5).mean(axis=0)
    for multiplicative in (False, True):
        got = cardiac.slice_waveform(series, offsets, n_steps, scaled=scaled, multiplicative=multiplicative).orderBy("t").collect()
        assert [r.t for r in got] == list(range(100)) and [r.cycle for r in got[:5]] == pytest.approx(cycle)
        assert [r.v for r in got] == pytest.approx(want / np.tile(1 + cycle, 20) if multiplicative else want - np.tile(cycle, 20))
    assert cardiac.slice_waveform(series.limit(0), offsets, n_steps).count() == 0


def test_a_heart_beat_faster_than_the_volumes(spark):
    """1.1 beats a second in volumes of 2 s: too slow by themselves, but not their ten slices."""
    rng, tr, n = np.random.default_rng(2), 2.0, 10
    beat = lambda t: -np.sin(2 * np.pi * 1.1 * t)
    rows = [(s, 1.0, (beat(tr * np.arange(100) + s * tr / n) + 0.5 * rng.normal(size=100) + s).tolist()) for s in range(n) for _ in range(20)]
    series = spark.createDataFrame(rows, "slice int, weight double, values array<double>")
    got = cardiac.slice_waveform(series, spark.createDataFrame([(s, s) for s in range(n)], "slice int, offset int"), n).orderBy("t").collect()
    power = np.abs(np.fft.rfft([r.v for r in got]))
    assert np.fft.rfftfreq(1000, tr / n)[power.argmax()] == pytest.approx(1.1, abs=0.01)
