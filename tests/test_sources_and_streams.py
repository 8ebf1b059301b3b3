"""Text and volume sources by round trip, streams against the same batch query."""

from __future__ import annotations

import gzip
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagmill.sources import text, volumes
from lagmill.streaming import live


def test_specs():
    assert text.columns_of("3,0-1,1") == [0, 1, 3]
    assert text.file_spec("a/b.txt:1-2") == ("a/b.txt", "1-2") and text.file_spec("file:///a/b.txt") == ("file:///a/b.txt", None)


def test_timeseries_round_trip(spark, tmp_path):
    rows = [(t, n, t * 1.5 + k) for t in range(7) for k, n in enumerate(("one", "two"))]
    root = f"{tmp_path}/run"
    text.write_timeseries(spark.createDataFrame(rows, "t int, name string, value double"), root, ["one", "two"], 2.0, 1.0)
    got, rate, start = text.read_timeseries(spark, root)
    assert (rate, start) == (2.0, 1.0)
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_tables_and_vectors(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\tn/a\n2\t4\n")
    assert sorted(map(tuple, text.read_table(spark, str(tmp_path / "a.tsv")).collect())) == [(0, "x", 1.0), (0, "y", 0.0), (1, "x", 2.0), (1, "y", 4.0)]
    (tmp_path / "b.csv").write_text("1,2\n3,4\n")
    assert {r.name for r in text.read_table(spark, str(tmp_path / "b.csv"), ",").collect()} == {"col_00", "col_01"}
    (tmp_path / "v.txt").write_text("name other\n1 2 3\n\n4 5 6\n")
    assert sorted(map(tuple, text.read_vectors(spark, str(tmp_path / "v.txt"), "0,2").collect())) == [(0, "col_00", 1.0), (0, "col_02", 3.0), (1, "col_00", 4.0), (1, "col_02", 6.0)]
    (tmp_path / "d.mat").write_text("/NumWaves 2\n/Matrix\n1 2\n3 4\n")
    assert sorted(r.value for r in text.read_design(spark, str(tmp_path / "d.mat")).collect()) == [1.0, 2.0, 3.0, 4.0]
    (tmp_path / "m.par").write_text("1 2 3 4 5 6\n")
    row = text.read_motion(spark, str(tmp_path / "m.par")).first()
    assert (row.X, row.RotZ, row.maxtrans, row.minrot) == (4.0, 3.0, 6.0, 1.0)
    (tmp_path / "e.txt").write_text("0 2 5\n4 1\n")
    assert [tuple(r) for r in text.read_events(spark, str(tmp_path / "e.txt")).collect()] == [(0, 0.0, 2.0, 5.0), (1, 4.0, 1.0, 1.0)]
    (tmp_path / "k.txt").write_text("a:\tb c\nd e\n")
    assert {r.key: r.value for r in text.read_keys(spark, str(tmp_path / "k.txt")).collect()} == {"a": "b c", "d": "e"}
    (tmp_path / "s.json").write_text('{"SliceTiming": [0.0, 0.5]}')
    assert [r.time for r in text.slice_times(spark, str(tmp_path / "s.json")).collect()] == [0.0, 0.5]
    assert text.read_sidecar(spark, str(tmp_path / "none.json")) == {}


def test_volumes(spark, tmp_path):
    data = np.random.default_rng(0).normal(size=(3, 4, 2, 5)).astype("f4")
    data[0, 0, 0, 0] = np.nan
    (tmp_path / "a.nii").write_bytes(volumes.encode_volume(data, (2.0, 2.0, 3.0), 1.5))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(volumes.encode_volume(data, (2.0, 2.0, 3.0), 1.5)))
    heads = volumes.read_headers(spark, str(tmp_path)).collect()
    assert len(heads) == 2 and all((r.nx, r.ny, r.nz, r.nt, r.dz, r.tr) == (3, 4, 2, 5, 3.0, 1.5) for r in heads)
    for r in volumes.read_volumes(spark, str(tmp_path)).collect():
        assert r["values"] == pytest.approx(np.nan_to_num(data[r.x, r.y, r.z]))
        assert r.series_id == r.x + 3 * r.y + 12 * r.z


def events(spark, n=200):
    base = datetime(2026, 1, 1)
    rows = [(f"k{i % 3}", base + timedelta(seconds=37 * i), float((i * 7) % 11)) for i in range(n)]
    return spark.createDataFrame(rows, "key string, ts timestamp, v double")


def stream(spark, tmp_path, df):
    df.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")


def run(df, spark, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    df = events(spark)
    live_df = stream(spark, tmp_path, df)
    make = lambda d: live.windowed_statistics(d, "key", "ts", "v", "10 minutes", "5 minutes", "20 minutes")
    got = run(make(live_df), spark, tmp_path, "windows", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, make(df).collect()))
    runs = lambda d: live.sessions(d, "key", "ts", "2 minutes", "20 minutes")
    assert sorted(map(tuple, run(runs(live_df), spark, tmp_path, "sess", "complete").collect())) == sorted(map(tuple, runs(df).collect()))


def test_streamed_filter_follows_a_loop(spark, tmp_path):
    df = events(spark, 60)
    got = run(live.kalman_level(stream(spark, tmp_path, df), "key", "ts", "v", 0.1, 1.0), spark, tmp_path, "kalman", "append")
    for key in ("k0", "k1", "k2"):
        level = None
        for r in got.where(F.col("key") == key).orderBy("ts").collect():
            if level is None:
                level, var = r.v, 1.0
            else:
                var += 0.1
                gain = var / (var + 1.0)
                level, var = level + gain * (r.v - level), (1 - gain) * var
            assert (r.level, r.variance) == pytest.approx((level, var))
