"""Regions: connected, complete, balanced, bounded, the same on every run."""

from __future__ import annotations

from collections import Counter
from hashlib import md5
from itertools import product
from math import log1p

import pytest

from lagmill.operators import partition
from lagmill.operators.partition import grown_regions


def connected(cells):
    left, todo = set(cells), [next(iter(cells))]
    while todo:
        p = todo.pop()
        if p in left:
            left.discard(p)
            todo += [tuple(a + d * s for a, d in zip(p, e, strict=True)) for e in ((1, 0, 0), (0, 1, 0), (0, 0, 1)) for s in (1, -1)]
    return not left


def test_regions(spark):
    places = [p for p in product(range(6), range(6), range(2)) if (p[0] - 2) ** 2 + (p[1] - 2) ** 2 < 12]
    places += [(20, 0, 0), (20, 0, 1)]  # out of reach unless a seed falls there
    at = dict(enumerate(places))
    mask = spark.createDataFrame([(i, *p, "x") for i, p in at.items()], "id long, x int, y int, z int, region string")
    spread = {}
    for alpha, most in ((0.0, None), (4.0, 1.25)):
        got = {r.id: r.region for r in grown_regions(mask, 9, 3, alpha, most=most).collect()}
        assert got.keys() == at.keys() and {r for r in got.values() if r is not None} == set(range(9))
        for k in range(9):
            assert connected({at[i] for i, r in got.items() if r == k})
        assert all(at[i][0] == 20 for i, r in got.items() if r is None)
        sizes = Counter(r for r in got.values() if r is not None)
        spread[alpha] = max(sizes.values()) - min(sizes.values())
        if most:
            assert max(sizes.values()) <= -(-most * len(places) // 9) * 1.1 ** 3
    again = grown_regions(mask.repartition(7).orderBy("z"), 9, 3, 4.0, most=1.25)
    assert {r.id: r.region for r in again.collect()} == got and spread[4.0] < spread[0.0]
    with pytest.raises(ValueError):
        grown_regions(mask.limit(3), 4)


def drawn(seed, *parts):
    return int(md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()[:13], 16) / (1 << 52)


def round_by_round(at, count, seed, alpha):
    """Regions as the rounds give them, cell by cell."""
    region = {i: k for k, i in enumerate(sorted(at, key=lambda i: (drawn(seed, i), i))[:count])}
    place = {p: i for i, p in at.items()}
    while True:
        sizes, new = Counter(region.values()), {}
        for i, p in at.items():
            if i not in region:
                near = {region[j] for d in (1, -1) for k in range(3) if (j := place.get(tuple(v + d * (k == a) for a, v in enumerate(p)))) in region}
                if near:
                    new[i] = min((-log1p(-drawn(seed, i, r)) * (sizes[r] + 1.0) ** alpha, r) for r in near)[1]
        if not new:
            return region
        region |= new


@pytest.mark.parametrize(("side", "count", "alpha", "box", "run"), [(8, 12, 2.0, 1 << 15, 100_000), (4, 5, 2.0, 64, 40), (3, 40, 0.0, 16, 1)])
def test_regions_of_a_long_bar_equal_those_round_by_round(spark, monkeypatch, side, count, alpha, box, run):
    """Whatever the boxes and the races that one task settles."""
    monkeypatch.setattr(partition, "BOX", box)
    monkeypatch.setattr(partition, "RUN", run)
    at = {10_000_000_000_000_001 + i: p[::-1] for i, p in enumerate(product(range(90 if run > 1 else 16), range(side), range(side))) if i % 11}
    at |= {5: (0, 99, 0), 6: (0, 100, 0)}  # out of reach unless a seed falls there
    got = grown_regions(spark.createDataFrame([(i, *p) for i, p in at.items()], "id long, x int, y int, z int"), count, 7, alpha)
    want = round_by_round(at, count, 7, alpha)
    assert {r.id: r.region for r in got.collect()} == {i: want.get(i) for i in at}


def test_written_tables_do_not_grow_with_the_depth_of_regions(spark, monkeypatch):
    written, materialize = [], partition.materialize
    monkeypatch.setattr(partition, "materialize", lambda df, label, *parts: written.append(label) or materialize(df, label, *parts))
    deep = spark.range(400).selectExpr("id", "0 AS x", "0 AS y", "id AS z")
    assert grown_regions(deep, 2, 1).where("region is null").count() == 0
    assert len(written) < 30  # before: one a round, a hundred or more
