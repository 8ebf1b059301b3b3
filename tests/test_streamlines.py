"""Streamlines against a loop over single particles, and sampling along them."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from lagmill.operators import streamlines


def direction(cells, p):
    low = np.floor(p).astype(int)
    total, weight = np.zeros(3), 0.0
    for d in product((0, 1), repeat=3):
        q = tuple((low + d).tolist())
        if q in cells:
            w = np.prod([(p - low)[i] if d[i] else 1 - (p - low)[i] for i in range(3)])
            total, weight = total + w * cells[q], weight + w
    n = np.linalg.norm(total)
    return total / n if weight >= 0.5 and n >= 1e-6 else None


def follow(cells, p, sign, sizes, step, most):
    out, last, h = [p], None, sign * step / np.array(sizes)
    for _ in range(most):
        ks = []
        for f in (0, 0.5, 0.5, 1):
            k = direction(cells, p + f * h * (ks[-1] if ks else 0))
            if k is None:
                return out
            ks.append(k)
        v = (ks[0] + 2 * ks[1] + 2 * ks[2] + ks[3]) / 6
        if np.linalg.norm(v) < 1e-6:
            return out
        v = v / np.linalg.norm(v)
        if last is not None and v @ last < 0:
            return out
        last, p = v, p + h * v
        out.append(p)
    return out


@pytest.mark.parametrize("block", [3, 16])
def test_lines_are_those_of_single_particles(spark, monkeypatch, block):
    monkeypatch.setattr(streamlines, "MOST_PARTICLES", 7)  # several tasks a block
    rng, sizes = np.random.default_rng(3), (1.0, 2.0, 1.5)
    cells = {}
    for p in product(range(-4, 6), range(7), range(6)):
        if rng.random() > 0.08:
            swirl = np.array([-(p[1] - 3.0), p[0] - 1.0, 0.6]) + 0.5 * rng.normal(size=3)
            cells[p] = swirl / np.linalg.norm(swirl)
    rows = [(*p, *map(float, u)) for p, u in cells.items()] + [(40, 0, 0, None, 0.0, 1.0)]
    field = spark.createDataFrame(rows, "x int, y int, z int, ux double, uy double, uz double")
    seeds = {i: np.array(p, float) for i, p in enumerate(sorted(cells)) if i % 9 == 0} | {5000: np.array([90.0, 0, 0])}
    table = spark.createDataFrame([(i, *map(float, p)) for i, p in seeds.items()] + [(6000, None, 0.0, 0.0)], "seed_id long, x double, y double, z double")
    got = {}
    found = streamlines.traced(field, table, sizes, 0.7, 25, block)
    for r in found.collect():
        got.setdefault((r.seed_id, r.half), {})[r.k] = (r.x, r.y, r.z)
    want = {(i, s): follow(cells, p, s, sizes, 0.7, 25) for i, p in seeds.items() for s in (1, -1)}
    assert got.keys() == want.keys() and max(map(len, want.values())) == 26
    for key, line in want.items():
        assert np.array([got[key][k] for k in range(len(got[key]))]) == pytest.approx(np.array(line), abs=1e-9), key
    lines = {}
    for r in streamlines.spliced(found, sizes, 6.0).collect():
        lines.setdefault(r.seed_id, {})[r.place] = r
    for i in seeds:
        path = [*want[i, -1][:0:-1], *want[i, 1]]
        length = sum(np.linalg.norm((b - a) * sizes) for a, b in zip(path, path[1:], strict=False))
        assert (i in lines) == (length >= 6)
        if i in lines:
            assert len(lines[i]) == len(path) and lines[i][0].length == pytest.approx(length)
    assert streamlines.traced(field, table.limit(0)).count() == 0 and streamlines.traced(field.limit(0), table).count() == 2 * len(seeds)


def test_maps_along_lines(spark):
    cells = {p: float(p[0] + 10 * p[1] + 100 * p[2]) for p in product(range(4), repeat=3) if p != (1, 1, 1)}
    maps = spark.createDataFrame([(*p, v, int(v)) for p, v in cells.items()], "x int, y int, z int, arrival double, region int")
    points = [(1, 0, 2.25, 2.5, 0.75), (1, 1, 1.2, 1.0, 1.0), (2, -1, 3.0, 3.0, 3.0), (2, 0, 1.0, 1.0, 1.0), (3, 0, 9.0, 0.0, 0.0)]
    vertices = spark.createDataFrame(points, "seed_id long, place int, x double, y double, z double")
    got = {(r.seed_id, r.place): (r.arrival, r.region) for r in streamlines.sampled(vertices, maps, ["arrival"], ["region"]).collect()}
    assert got == {(1, 0): (pytest.approx(2.25 + 25 + 75), 132), (1, 1): (pytest.approx(112.0), None), (2, -1): (333.0, 333), (2, 0): (None, None), (3, 0): (None, None)}
