"""Forests, unwrapping and conditional modes against heaps and loops on small grids."""

from __future__ import annotations

import heapq
import random
from itertools import product

import numpy as np
import pytest

from lagmill.operators import candidates, forests


def prim(edges, first):
    """Edges of the maximum spanning tree around first, in the order a heap takes them: (from, to)."""
    near = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    seen, heap, out = {first}, [], []

    def push(u):
        for v, w in near.get(u, ()):
            if v not in seen:
                heapq.heappush(heap, (-w, min(u, v), max(u, v), u, v))

    push(first)
    while heap:
        _, _, _, u, v = heapq.heappop(heap)
        if v not in seen:
            seen.add(v)
            out.append((u, v))
            push(v)
    return out, seen


def test_forest_and_parents(spark):
    rnd = random.Random(3)
    edges = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), rnd.choice([0.5, rnd.random()])) for a, b in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(90)) if a != b}.values())
    table = spark.createDataFrame([*edges, edges[0], (7, 7, 9.0), (200, 201, None)], "u long, v long, weight double")
    forest, members = forests.spanning_forest(table)
    trees = {}
    for r in members.collect():
        trees.setdefault(r.tree, set()).add(r.id)
    want, tops = set(), {}
    for tree, ids in trees.items():
        if 200 in ids:
            want.add((200, 201))
            tops[tree] = (201, [(201, 200)])
            continue
        top = rnd.choice(sorted(ids))
        took, seen = prim(edges, top)
        assert seen == ids
        want |= {(min(e), max(e)) for e in took}
        tops[tree] = (top, took)
    assert {tuple(r) for r in forest.collect()} == want
    hung = forests.parents(forest, spark.createDataFrame([(t,) for t, _ in tops.values()] + [(999,)], "id long"))
    got = {r.id: r.parent for r in hung.collect()}
    assert got == {v: u for _, took in tops.values() for u, v in took} | {t: t for t, _ in tops.values()}


def test_states_are_handed_down(spark):
    n, rnd = 200, random.Random(4)
    step = {i: [rnd.randrange(3) for _ in range(3)] for i in range(n)}
    up = {i: i - 1 if i else 0 for i in range(150)} | {i: rnd.randrange(i) for i in range(150, n)}
    rows = spark.createDataFrame([(i, up[i], step[i]) for i in range(n)] + [(999, 999, None)], "id long, parent long, step array<int>")
    state = {0: 2}
    for i in range(1, n):
        state[i] = step[i][state[up[i]]]
    from pyspark.sql import functions as F

    assert {r.id: r.state for r in forests.handed_down(rows, F.lit(2)).collect()} == state | {999: 2}


def grid_cells(rnd, shape, empty=0.1, gradient=None):
    rows = []
    for i, p in enumerate(product(*map(range, shape))):
        n = 0 if rnd.random() < empty else rnd.randint(1, 3)
        amps = sorted((round(rnd.random(), 2) for _ in range(n)), reverse=True)
        rows.append((i, *p, [round(rnd.uniform(-9, 9), 3) for _ in range(n)], amps, *(gradient(p) if gradient else (0.0, 0.0, 0.0))))
    return rows


def near(p, q):
    return p != q and all(abs(a - b) <= 1 for a, b in zip(p, q, strict=True))


@pytest.mark.parametrize("graded", [False, True])
def test_unwrapping_is_growth_by_a_heap(spark, graded):
    rnd = random.Random(5)
    sizes = (2.0, 1.0, 3.0)
    rows = grid_cells(rnd, (4, 5, 3), 0.25, (lambda p: (rnd.uniform(-1, 1), rnd.uniform(-1, 1), None if rnd.random() < 0.2 else rnd.uniform(-1, 1))) if graded else None)
    rows += [(500, 20, 20, 20, [1.0, 2.0], [0.5, 0.4], 0.0, 0.0, 0.0)]
    cells = {r[0]: r for r in rows if r[4]}
    sure = {i: r[5][0] - (r[5][1] if len(r[5]) > 1 else 0.0) for i, r in cells.items()}
    edges = [(i, j, min(sure[i], sure[j])) for i in cells for j in cells if i < j and near(cells[i][1:4], cells[j][1:4])]
    tau, left = {}, set(cells)
    while left:
        top = min(left, key=lambda i: (-sure[i], i))
        tau[top] = cells[top][4][0]
        took, seen = prim(edges, top)
        for u, v in took:
            delta = sum((cells[v][1 + a] - cells[u][1 + a]) * sizes[a] * ((cells[v][6 + a] or 0) + (cells[u][6 + a] or 0)) / 2 for a in range(3)) if graded else 0.0
            delta = max(-1.5, min(1.5, delta))
            tau[v] = min(cells[v][4], key=lambda c: (abs(c - tau[u] - delta), cells[v][4].index(c)))
        left -= seen
    table = spark.createDataFrame(rows, "id long, x int, y int, z int, lags array<double>, amps array<double>, gx double, gy double, gz double")
    table = table if graded else table.drop("gx", "gy", "gz")
    got = candidates.unwrapped(table, sizes, 1.5).collect()
    assert {r.id: r.tau for r in got if r.tau is not None} == pytest.approx(tau) and len(got) == len(rows)
    assert all(r.changed == (r.tau != cells[r.id][4][0]) for r in got if r.id in cells) and all(r.tree is None for r in got if r.id not in cells)
    assert {r.id: r.confidence for r in got if r.id in cells} == pytest.approx(sure)
    assert candidates.unwrapped(table.limit(0)).count() == 0


def test_a_wrapped_map_is_unwrapped(spark):
    """A smooth map whose strongest candidates are off by a period in a patch of unsure cells."""
    rows, truth = [], {}
    for i, (x, y, z) in enumerate(product(range(6), range(6), range(2))):
        t = 0.3 * x + 0.2 * y + 0.1 * z
        patch = x in (2, 3) and y in (2, 3)
        truth[i] = t
        rows.append((i, x, y, z, [t + 8, t, t - 8] if patch else [t, t + 8, t - 8], [0.8, 0.79, 0.3] if patch else [0.9, 0.4, 0.3]))
    cells = spark.createDataFrame(rows, "id long, x int, y int, z int, lags array<double>, amps array<double>")
    got = candidates.resolved(cells).collect()
    assert {r.id: r.tau for r in got} == pytest.approx(truth) and sum(r.moved for r in got) == 8


def test_modes_are_a_coloured_loop_and_lower_the_energy(spark):
    rnd = random.Random(6)
    rows = [r[:6] for r in grid_cells(rnd, (4, 4, 4))]
    cells = {r[0]: r for r in rows if r[4]}
    tau = {i: r[4][0] for i, r in cells.items()}
    around = {i: [j for j in cells if near(cells[i][1:4], cells[j][1:4])] for i in cells}
    energy = lambda: sum(abs(tau[i] - tau[j]) for i in cells for j in around[i] if i < j)
    table = spark.createDataFrame(rows, "id long, x int, y int, z int, lags array<double>, amps array<double>")
    start = spark.createDataFrame(list(tau.items()), "id long, tau double")
    energies = [energy()]
    for sweeps in (1, 2):
        for k in range(8):
            for i in [i for i, r in cells.items() if r[1] % 2 + 2 * (r[2] % 2) + 4 * (r[3] % 2) == k]:
                cost = [round(sum(abs(c - tau[j]) for j in around[i]), 9) for c in cells[i][4]]
                if around[i] and min(cost) < round(sum(abs(tau[i] - tau[j]) for j in around[i]), 9):
                    tau[i] = cells[i][4][int(np.argmin(cost))]
        energies.append(energy())
        found = candidates.conditional_modes(table, start, sweeps)
        assert {r.id: r.tau for r in found.collect() if r.tau is not None} == pytest.approx(tau) and found.count() == len(rows)
        assert candidates.field_energy(table, found).first().energy == pytest.approx(energies[-1])
    assert energies == sorted(energies, reverse=True) and energies[0] > energies[1]
