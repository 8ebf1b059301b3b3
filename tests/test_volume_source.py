"""The volume data source by round trips, its ranges over a file of more than 2 GB, and its commit."""

from __future__ import annotations

import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagmill.sources import volume_source as V
from lagmill.sources.volumes import encode_volume, read_volumes


def cells(spark, values):
    nx, ny, nz, _ = values.shape
    rows = [(x, y, z, values[x, y, z].tolist(), float(values[x, y, z, 0])) for x in range(nx) for y in range(ny) for z in range(nz)]
    return spark.createDataFrame(rows, "x int, y int, z int, lags array<double>, first double")


def test_maps_round_trip(spark, tmp_path):
    values = np.random.default_rng(1).normal(size=(5, 4, 3, 7)).astype(np.float32).astype(float)
    rows = cells(spark, values).where("not (x = 1 and y = 2)").withColumn("first", F.when(F.col("x") == 4, F.lit(None)).otherwise(F.col("first")))
    root = f"{tmp_path}/run/sub-1"
    files = V.save_maps(rows, root, (5, 4, 3), (2.0, 2.0, 3.0), 1.5, 7, {"first": {"Units": "second"}})
    assert sorted(map(os.path.basename, files)) == ["sub-1_desc-first_map.nii", "sub-1_desc-lags_map.nii"]
    want = values.copy()
    want[1, 2] = 0
    got = {(r.x, r.y, r.z): r for r in V.load(spark, files[0]).collect()}
    assert len(got) == 60 and all(r.values == want[p].tolist() and r.series_id == p[0] + 5 * p[1] + 20 * p[2] for p, r in got.items())
    first = {(r.x, r.y, r.z): r.values for r in V.load(spark, files[1]).collect()}
    assert all(v == [0.0 if p[0] == 4 else want[p][0]] for p, v in first.items())
    note = json.load(open(files[1].replace(".nii", ".json")))
    assert note == {"Cells": 57, "Units": "second"}
    with open(files[0], "rb") as f:
        head = V.parse(V._start(f))
    assert (head.shape, head.sizes, head.step) == ((5, 4, 3, 7), (2.0, 2.0, 3.0), 1.5)
    both = V.load(spark, f"{tmp_path}/run")
    assert both.count() == 120 and both.select("path").distinct().count() == 2
    assert sorted(os.listdir(f"{tmp_path}/run")) == sorted(f"sub-1_desc-{n}_map.{e}" for n in ("first", "lags") for e in ("json", "nii"))


def test_first_format_and_compressed_files(spark, tmp_path):
    values = np.random.default_rng(2).normal(size=(3, 4, 2, 6)).astype(np.float32)
    data = encode_volume(values, (2.0, 2.0, 2.0), 0.7)
    (tmp_path / "a.nii").write_bytes(data)
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(data))
    old = {(r.x, r.y, r.z): r.values for r in read_volumes(spark, f"{tmp_path}/a.nii").collect()}
    for name in ("a.nii", "b.nii.gz"):
        assert {(r.x, r.y, r.z): r.values for r in V.load(spark, f"{tmp_path}/{name}").collect()} == old
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert {r.series_id for r in V.load(spark, f"{tmp_path}/*").where("series_id >= 5 and series_id < 9").collect()} == set(range(5, 9))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="neither|openable|open"):
        V.load(spark, "s3://bucket/a.nii").count()


def test_bounds_leave_cells_unread(tmp_path):
    (tmp_path / "a.nii").write_bytes(encode_volume(np.zeros((10, 10, 10, 4), np.float32), (1.0, 1.0, 1.0), 1.0))
    reader = V.BoundedReader(f"{tmp_path}/a.nii", 1600, False)
    list(reader.pushFilters([V.GreaterThan(("series_id",), 449), V.LessThanOrEqual(("series_id",), 620), V.EqualTo(("x",), 3)]))
    assert [(p.first, p.last) for p in reader.partitions()] == [(450, 550), (550, 621)]


def test_a_file_of_more_than_two_gigabytes_is_read_in_ranges(tmp_path):
    shape = (300, 300, 80, 100)  # 2.9 GB, sparse
    path = tmp_path / "big.nii"
    head = V._header_bytes(shape, (1.0, 1.0, 1.0), 1.0, None)
    cell, t = 300 * 300 * 80 - 2, 99
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(len(head) + 4 * int(np.prod(shape)))
        f.seek(len(head) + 4 * (t * 300 * 300 * 80 + cell))
        f.write(np.float32(7.5).tobytes())
    assert os.path.getsize(path) > 2**31
    reader = V.VolumeReader(str(path), V.TASK_BYTES, False)
    parts = reader.partitions()
    assert len(parts) > 40 and parts[0].first == 0 and parts[-1].last == 300 * 300 * 80 and all(a.last == b.first for a, b in zip(parts, parts[1:], strict=False))
    batch = next(r for b in reader.read(parts[-1]) for r in b.to_pylist() if r["series_id"] == cell)
    assert batch["series_id"] == cell and batch["values"][t] == 7.5 and sum(batch["values"]) == 7.5 and (batch["x"], batch["y"], batch["z"]) == (298, 299, 79)


def test_grayordinates_round_trip(spark, tmp_path):
    models = [{"structure": "CORTEX_LEFT", "offset": 0, "count": 4, "vertices": [0, 2, 3, 9]}, {"structure": "THALAMUS", "offset": 4, "count": 3, "voxels": [[1, 2, 3], [4, 5, 6], [7, 8, 9]]}]
    values = np.arange(35, dtype=float).reshape(7, 5)
    rows = spark.createDataFrame([(i, values[i].tolist()) for i in (5, 0, 3, 6, 1, 2)], "series_id long, lags array<double>")
    (file,) = V.save_maps(rows, f"{tmp_path}/g", (7, 1, 1), step=0.72, steps=5, models=models)
    assert file.endswith("_desc-lags_map.dtseries.nii")
    got = {r.series_id: r for r in V.load(spark, file, gray=True).collect()}
    assert {i: r.values for i, r in got.items()} == {i: (values[i] if i != 4 else 0 * values[i]).tolist() for i in range(7)}
    assert (got[3].structure, got[3].vertex, got[3].x) == ("CORTEX_LEFT", 9, None) and (got[5].structure, got[5].vertex, got[5].x, got[5].y, got[5].z) == ("THALAMUS", None, 4, 5, 6)
    with open(file, "rb") as f:
        head = V.parse(V._start(f))
    assert head.models == models and head.step == 0.72 and head.shape == (7, 1, 1, 5)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([(0, 0, 0, 1.0), (9, 0, 0, 2.0)], "x int, y int, z int, m double")
    with pytest.raises(Exception, match="outside"):
        V.save_maps(bad, f"{tmp_path}/out", (2, 2, 2))
    assert os.listdir(tmp_path) == []
    good = bad.where("x = 0")
    V.save_maps(good, f"{tmp_path}/out", (2, 2, 2))
    assert V.load(spark, f"{tmp_path}/out_desc-m_map.nii").where("values[0] = 1.0").count() == 1
    V.save_maps(good.limit(0), f"{tmp_path}/none", (2, 2, 2))
    assert V.load(spark, f"{tmp_path}/none_desc-m_map.nii").where("values[0] = 0.0").count() == 8
