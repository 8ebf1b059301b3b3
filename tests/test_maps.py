"""Map operators on small grids and reports."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagmill.functions import series as S
from lagmill.operators import grids, maps


def test_run_comparison(spark):
    a = spark.createDataFrame([("lag", 1, 1.0), ("lag", 2, 0.0), ("amp", 1, 4.0), ("only", 1, 1.0)], "map string, series_id int, value double")
    b = spark.createDataFrame([("lag", 1, 2.0), ("lag", 2, 3.0), ("amp", 1, 4.0)], "map string, series_id int, value double")
    got = {r.map: r for r in maps.compare_runs(a, b).collect()}
    assert set(got) == {"lag", "amp"} and got["lag"].meandiff == 2.0 and got["lag"].meanreldiff == 0.5 and got["amp"].maxdiff == 0.0
    x, y = (d.where("map = 'lag'").drop("map") for d in (a, b))
    assert maps.same_values(x, x, 0, 0).first().matches and not maps.same_values(x, y, 1, 1).first().matches
    assert not maps.same_values(x, x.limit(1), 9, 9).first().matches


def test_reports_of_different_keys(spark, tmp_path):
    for i, r in enumerate(({"a": 1, "b": 2.5}, {"b": 3.5, "c": "x"})):
        (tmp_path / f"{i}.json").write_text(json.dumps(r))
    rows = maps.merge_reports(spark, [str(tmp_path / "0.json"), str(tmp_path / "1.json")]).orderBy("report").collect()
    assert [(r.a, r.b, r.c) for r in rows] == [(1, 2.5, None), (None, 3.5, "x")]


def test_neighbours_and_smoothing(spark):
    cells = [(x, y, z, float(x == y == z == 2)) for x in range(5) for y in range(5) for z in range(5)]
    grid = spark.createDataFrame(cells, "x int, y int, z int, v double")
    assert {r.n for r in grids.neighbors(grid, 1.0).groupBy("x", "y", "z").agg(F.count("*").alias("n")).collect()} == {3, 4, 5, 6}
    smooth = {(r.x, r.y, r.z): r.v for r in grids.gaussian_smooth(grid, "v", 0.6).collect()}
    assert smooth[2, 2, 2] == max(smooth.values()) and smooth[1, 2, 2] == pytest.approx(smooth[2, 2, 3])
    assert grids.erode(grid).count() == 27
    lags = grid.withColumn("lag", F.col("v") * 10)
    assert [(r.x, r.y, r.z) for r in grids.despeckle(lags, 5.0).where("speckle").collect()] == [(2, 2, 2)]


def test_gradients_and_atlases(spark):
    cells = [(x, y, 0, 2.0 * x - y, x % 3) for x in range(4) for y in range(3)]
    grid = spark.createDataFrame(cells, "x int, y int, z int, v double, label int")
    rows = maps.gradients(grid, "v").collect()
    assert all((r.g_x, r.g_y, r.g_z) == (2.0, -1.0, None) and r.slope == pytest.approx(5**0.5) for r in rows)
    assert maps.one_hot(grid, [1, 2]).agg(F.sum("label_1"), F.sum("label_2")).first()[:] == (3, 3)


def test_small_column_functions(spark):
    df = spark.range(1).select(F.array(*map(F.lit, (1.0, 2.0, 2.0))).alias("a"), F.array(*map(F.lit, (1.0, 0.0, 0.0))).alias("b"))
    row = df.select(S.rms(F.col("a")).alias("rms"), S.orthogonal(F.col("a"), F.col("b")).alias("o"), S.value_index(F.lit(0.0), F.lit(0.5), F.lit(4), F.lit(0.75)).alias("i"),
                    S.phase_wrap(F.lit(4.0)).alias("p"), S.phase_wrap(F.lit(-1.0), False).alias("q")).first()
    assert row.rms == pytest.approx(3**0.5) and row.o == [0.0, 2.0, 2.0] and row.i == 2
    assert row.p == pytest.approx(4 - 2 * np.pi) and row.q == pytest.approx(2 * np.pi - 1)


def test_t_statistics(spark):
    g = np.random.default_rng(0)
    x = g.normal(size=(2, 12))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x.T], "a double, b double")
    d = x[0] - x[1]
    got = maps.paired_t(df, [], "a", "b").first()
    assert got.t == pytest.approx(d.mean() / (d.std(ddof=1) / 12**0.5)) and got.dof == 11
