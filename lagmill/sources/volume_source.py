"""Volumes and grayordinates as a Spark data source: byte ranges to read in parallel, tasks that write in place and one commit.

`spark.read.format("lagmill.volumes")` gives a row per voxel or grayordinate with its whole history; `df.write.format("lagmill.volumes")` writes every map
column to a file of its own. Formats: NIfTI-1 and NIfTI-2 (.nii, .nii.gz to read), and CIFTI-2 dense series.
"""

from __future__ import annotations

import glob
import gzip
import json
import os
import struct
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from lagmill.sources.volumes import TIME_UNITS, TYPES

NAME = "lagmill.volumes"
#: Bytes that one task reads, about.
TASK_BYTES = 64 << 20
#: Intent codes of dense series and dense scalars, the extension code and the code of a NIfTI-2 file's magic.
DENSE_SERIES, DENSE_SCALARS, XML_CODE, MAGIC_2 = 3002, 3006, 32, b"n+2\0\r\n\032\n"
_VOXELS = "path string, series_id bigint, x int, y int, z int, values array<double>"
_GRAY = "path string, series_id bigint, structure string, vertex bigint, x int, y int, z int, values array<double>"


@dataclass
class Header:
    """Shape (x, y, z, t; for grayordinates count, 1, 1, t), cell sizes, step in seconds and where and how numbers are stored."""

    shape: tuple[int, int, int, int]
    sizes: tuple[float, float, float]
    step: float
    dtype: str
    offset: int
    slope: float
    inter: float
    models: list[dict] | None = None  # of grayordinates: structure, offset, count, and vertices or voxels

    @property
    def cells(self) -> int:
        return self.shape[0] * self.shape[1] * self.shape[2]


def _models(xml: bytes) -> tuple[list[dict], float]:
    """Brain models and step of a grayordinate file's description."""
    models, step = [], 1.0
    for at in ET.fromstring(xml.rstrip(b"\0")).iter("MatrixIndicesMap"):
        if at.get("IndicesMapToDataType") == "CIFTI_INDEX_TYPE_SERIES":
            step = float(at.get("SeriesStep", 1.0)) * 10.0 ** int(at.get("SeriesExponent", 0))
        for m in at.iter("BrainModel"):
            found = {"structure": m.get("BrainStructure"), "offset": int(m.get("IndexOffset")), "count": int(m.get("IndexCount"))}
            for tag, name in (("VertexIndices", "vertices"), ("VoxelIndicesIJK", "voxels")):
                if (node := m.find(tag)) is not None:
                    numbers = list(map(int, (node.text or "").split()))
                    found[name] = numbers if name == "vertices" else [numbers[i : i + 3] for i in range(0, len(numbers), 3)]
            models.append(found)
    return models, step


def parse(data: bytes) -> Header:
    """The header at the start of a file; data must reach to its first number if it describes grayordinates."""
    order = next((o for o in "<>" if struct.unpack_from(o + "i", data)[0] in (348, 540)), None)
    if order is None:
        raise ValueError("neither NIfTI-1 nor NIfTI-2")
    if struct.unpack_from(order + "i", data)[0] == 348:
        dim, pix = struct.unpack_from(order + "8h", data, 40), struct.unpack_from(order + "8f", data, 76)
        code = struct.unpack_from(order + "h", data, 70)[0]
        offset, slope, inter = struct.unpack_from(order + "3f", data, 108)
        units, intent = data[123], struct.unpack_from(order + "h", data, 68)[0]
    else:
        dim, pix = struct.unpack_from(order + "8q", data, 16), struct.unpack_from(order + "8d", data, 104)
        code = struct.unpack_from(order + "h", data, 12)[0]
        offset = struct.unpack_from(order + "q", data, 168)[0]
        slope, inter = struct.unpack_from(order + "2d", data, 176)
        units, intent = struct.unpack_from(order + "i", data, 500)[0], struct.unpack_from(order + "i", data, 504)[0]
    dtype = order + TYPES[code]
    slope = slope if slope and np.isfinite(slope) else 1.0
    if intent in (DENSE_SERIES, DENSE_SCALARS):
        size, kind = struct.unpack_from(order + "2i", data, 544)
        if kind != XML_CODE or len(data) < 544 + size:
            raise ValueError("a grayordinate file needs its description before its numbers")
        models, step = _models(data[552 : 544 + size])
        return Header((dim[6], 1, 1, dim[5]), (1.0, 1.0, 1.0), step, dtype, int(offset), slope, inter, models)
    full = tuple(max(1, d) for d in dim[1:5]) if dim[0] >= 4 else (*(max(1, d) for d in dim[1 : dim[0] + 1]), *[1] * (4 - dim[0]))
    return Header(full, tuple(map(float, pix[1:4])), pix[4] * TIME_UNITS.get(units & 56, 1.0), dtype, int(offset), slope, inter)


def _start(f) -> bytes:
    """A file's header, with all that stands before its numbers."""
    head = f.read(552)
    order = "<" if struct.unpack_from("<i", head)[0] in (348, 540) else ">"
    if struct.unpack_from(order + "i", head)[0] == 540:
        head += f.read(max(0, struct.unpack_from(order + "q", head, 168)[0] - 552))
    return head


def _local(path: str) -> str:
    """Path of a folder that driver and executors share; other stores can't be read in ranges or written in place."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: volumes need a path that the driver and all executors can open")
    return path.removeprefix("file://")


def _files(path: str) -> list[str]:
    path = _local(path)
    if os.path.isdir(path):
        path = os.path.join(path, "*.nii*")
    found = sorted(f for f in glob.glob(path) if f.endswith((".nii", ".nii.gz")))
    if not found:
        raise FileNotFoundError(path)
    return found


@dataclass
class Cells(InputPartition):
    """The cells first to last (exclusive) of a file."""

    path: str
    header: Header
    first: int
    last: int


@dataclass
class VolumeReader(DataSourceReader):
    path: str
    task_bytes: int
    gray: bool
    low: int = 0
    high: int | None = None

    def partitions(self) -> list[Cells]:
        """Ranges of cells of about task_bytes; a compressed file, which can't be entered in its middle, is one."""
        out = []
        for path in _files(self.path):
            packed = path.endswith(".gz")
            with (gzip.open if packed else open)(path, "rb") as f:
                header = parse(_start(f))
            if (header.models is not None) != self.gray:
                raise ValueError(f"{path}: volumes and grayordinates have different columns; read them by themselves")
            width = header.shape[3] * np.dtype(header.dtype).itemsize
            step = header.cells if packed else max(1, self.task_bytes // width)
            low, high = max(0, self.low), header.cells if self.high is None else min(self.high, header.cells)
            out += [Cells(path, header, at, min(at + step, high)) for at in range(low, high, step)]
        return out or [Cells("", Header((0, 1, 1, 1), (1.0,) * 3, 1.0, "<f4", 0, 1.0, 0.0), 0, 0)]

    def read(self, part: Cells) -> Iterator[pa.RecordBatch]:
        if part.first >= part.last:
            return
        h, n = part.header, part.last - part.first
        nx, ny, _, nt = h.shape
        item = np.dtype(h.dtype).itemsize
        with (gzip.open if part.path.endswith(".gz") else open)(part.path, "rb") as f:
            if h.models is not None:  # a grayordinate's history is in one piece
                f.seek(h.offset + part.first * nt * item)
                raw = np.frombuffer(f.read(n * nt * item), h.dtype).reshape(n, nt)
            else:
                raw = np.empty((n, nt), h.dtype)
                for t in range(nt):
                    f.seek(h.offset + (t * h.cells + part.first) * item)
                    raw[:, t] = np.frombuffer(f.read(n * item), h.dtype)
        values = np.nan_to_num(raw.astype(np.float64) * h.slope + h.inter)
        ids = np.arange(part.first, part.last)
        step = max(1, (8 << 20) // (8 * nt))
        for a in range(0, n, step):
            yield self._batch(part, ids[a : a + step], values[a : a + step], nx, ny, nt)

    def _batch(self, part: Cells, ids: np.ndarray, values: np.ndarray, nx: int, ny: int, nt: int) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * nt, pa.int32()), pa.array(values.ravel()))
        path = pa.array([part.path] * len(ids))
        if not self.gray:
            places = [pa.array(v.astype(np.int32)) for v in (ids % nx, ids // nx % ny, ids // (nx * ny))]
            return pa.RecordBatch.from_arrays([path, pa.array(ids), *places, lists], names=["path", "series_id", "x", "y", "z", "values"])
        rows = []
        for i in ids.tolist():
            m = next(m for m in part.header.models if m["offset"] <= i < m["offset"] + m["count"])
            k = i - m["offset"]
            rows.append((m["structure"], m["vertices"][k] if "vertices" in m else None, *(m["voxels"][k] if "voxels" in m else (None,) * 3)))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        places = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([path, pa.array(ids), *places, lists], names=["path", "series_id", "structure", "vertex", "x", "y", "z", "values"])


class BoundedReader(VolumeReader):
    """A reader that Spark hands its filters to, which needs spark.sql.python.filterPushdown.enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on series_id leave files' other cells unread; Spark still applies all filters."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("series_id",) and isinstance(f.value, int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    top = f.value + (not isinstance(f, LessThan))
                    self.high = top if self.high is None else min(self.high, top)
            yield f


def _header_bytes(shape: tuple[int, ...], sizes: tuple[float, ...], step: float, models: list[dict] | None) -> bytes:
    """Start of a NIfTI-2 file of float32 numbers, with its description if it holds grayordinates."""
    head = bytearray(544)
    struct.pack_into("<i8s2h", head, 0, 540, MAGIC_2, 16, 32)
    tail = b""
    if models is None:
        struct.pack_into("<8q", head, 16, 4, *shape, 1, 1, 1)
        struct.pack_into("<8d", head, 104, 1.0, *sizes, step, 1.0, 1.0, 1.0)
    else:
        struct.pack_into("<8q", head, 16, 6, 1, 1, 1, 1, shape[3], shape[0], 1)
        struct.pack_into("<8d", head, 104, 1.0, 1.0, 1.0, 1.0, 1.0, step, 1.0, 1.0)
        struct.pack_into("<i", head, 504, DENSE_SERIES)
        xml = _description(models, shape[3], step)
        size = -(-(8 + len(xml)) // 16) * 16
        head[540] = 1
        tail = struct.pack("<2i", size, XML_CODE) + xml.ljust(size - 8, b"\0")
    struct.pack_into("<q2d", head, 168, 544 + len(tail), 1.0, 0.0)
    struct.pack_into("<i", head, 500, 2 | 8)
    return bytes(head) + tail


def _description(models: list[dict], steps: int, step: float) -> bytes:
    root = ET.Element("CIFTI", Version="2")
    matrix = ET.SubElement(root, "Matrix")
    ET.SubElement(matrix, "MatrixIndicesMap", AppliesToMatrixDimension="0", IndicesMapToDataType="CIFTI_INDEX_TYPE_SERIES", NumberOfSeriesPoints=str(steps),
                  SeriesExponent="0", SeriesStart="0.0", SeriesStep=repr(step), SeriesUnit="SECOND")
    cells = ET.SubElement(matrix, "MatrixIndicesMap", AppliesToMatrixDimension="1", IndicesMapToDataType="CIFTI_INDEX_TYPE_BRAIN_MODELS")
    for m in models:
        surface = "vertices" in m
        kind = "CIFTI_MODEL_TYPE_SURFACE" if surface else "CIFTI_MODEL_TYPE_VOXELS"
        at = ET.SubElement(cells, "BrainModel", IndexOffset=str(m["offset"]), IndexCount=str(m["count"]), ModelType=kind, BrainStructure=m["structure"])
        numbers = m["vertices"] if surface else [n for v in m["voxels"] for n in v]
        ET.SubElement(at, "VertexIndices" if surface else "VoxelIndicesIJK").text = " ".join(map(str, numbers))
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


@dataclass
class Written(WriterCommitMessage):
    cells: int


class VolumeWriter(DataSourceArrowWriter):
    """Every task writes its cells at their places in files that the driver laid out; a task that runs again writes the same bytes. The
    files get their names at the commit, so a job that fails leaves none."""

    def __init__(self, root: str, maps: dict[str, int], key: list[str], shape: tuple[int, int, int], sizes: tuple[float, ...], step: float, models: list[dict] | None,
                 notes: dict[str, dict], overwrite: bool) -> None:
        self.root, self.maps, self.key, self.shape, self.notes, self.gray = root, maps, key, shape, notes, models is not None
        self.mark, self.starts = f".{uuid.uuid4().hex}", {}
        for name, steps in maps.items():
            if os.path.exists(self.name_of(name)) and not overwrite:
                raise FileExistsError(self.name_of(name))
        os.makedirs(os.path.dirname(os.path.abspath(root)), exist_ok=True)
        for name, steps in maps.items():
            head = _header_bytes((*shape, steps), sizes, step, models)
            with open(self.name_of(name) + self.mark, "wb") as f:
                f.write(head)
                f.truncate(len(head) + 4 * steps * shape[0] * shape[1] * shape[2])
            self.starts[name] = len(head)

    def name_of(self, name: str) -> str:
        return f"{self.root}_desc-{name}_map{'.dtseries' if self.gray else ''}.nii"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        nx, ny, nz = self.shape
        files = {name: os.open(self.name_of(name) + self.mark, os.O_WRONLY) for name in self.maps}
        cells = 0
        try:
            for batch in iterator:
                at = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in self.key]
                ids = at[0] if len(at) == 1 else at[0] + nx * (at[1] + ny * at[2])
                if len(ids) and (ids.min() < 0 or ids.max() >= nx * ny * nz):
                    raise ValueError("a cell lies outside the volume")
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                runs = np.flatnonzero(np.diff(ids, prepend=-2) != 1)
                cells += len(ids)
                for name, steps in self.maps.items():
                    column = batch.column(batch.schema.get_field_index(name))
                    rows = np.array([r if r is not None else [] for r in column.to_pylist()] if pa.types.is_list(column.type) else [[v] for v in column.to_pylist()], dtype=object)
                    values = np.zeros((len(ids), steps), "<f4")
                    for i, k in enumerate(order):
                        r = rows[k]
                        if len(r) not in (0, steps):
                            raise ValueError(f"{name}: {len(r)} values in a cell instead of {steps}")
                        values[i, : len(r)] = np.nan_to_num(np.array([0.0 if v is None else v for v in r], np.float64))
                    for a, b in zip(runs, [*runs[1:], len(ids)], strict=True):
                        if self.gray:
                            os.pwrite(files[name], values[a:b].tobytes(), self.starts[name] + 4 * steps * int(ids[a]))
                        else:
                            for t in range(steps):
                                os.pwrite(files[name], values[a:b, t].tobytes(), self.starts[name] + 4 * (t * nx * ny * nz + int(ids[a])))
        finally:
            for f in files.values():
                os.fsync(f)
                os.close(f)
        return Written(cells)

    def commit(self, messages: list[Written | None]) -> None:
        for name in self.maps:
            os.replace(self.name_of(name) + self.mark, self.name_of(name))
            note = {"Cells": sum(m.cells for m in messages if m), **self.notes.get(name, {})}
            with open(self.name_of(name).removesuffix(".nii").removesuffix(".dtseries") + ".json", "w") as f:
                json.dump(note, f, indent=1, sort_keys=True)

    def abort(self, messages: list[Written | None]) -> None:
        for name in self.maps:
            if os.path.exists(self.name_of(name) + self.mark):
                os.remove(self.name_of(name) + self.mark)


class VolumeSource(DataSource):
    """Options to read: path (a file, folder or pattern), gray ("true" for grayordinates), task_bytes, bounds ("true": take
    filters on series_id; Spark must have spark.sql.python.filterPushdown.enabled). To write: path (files are called
    <path>_desc-<column>_map.nii), shape "nx,ny,nz", sizes, step (seconds), steps (values of an array column), models (JSON, for
    grayordinates: their count is the first number of shape), notes (JSON: column -> what its sidecar says).

    Rows to write need x, y and z or, else, series_id (x fastest); every other number or array of numbers is a map. Cells without a row hold 0,
    like nulls and NaNs; of rows for one cell any may win. A null key fails the job.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _GRAY if self.options.get("gray", "") == "true" else _VOXELS

    def reader(self, schema) -> VolumeReader:
        kind = BoundedReader if self.options.get("bounds", "") == "true" else VolumeReader
        return kind(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)), self.options.get("gray", "") == "true")

    def writer(self, schema, overwrite: bool) -> VolumeWriter:
        o = self.options
        numbers = ("double", "float", "int", "bigint", "smallint", "tinyint")
        key = ["x", "y", "z"] if {"x", "y", "z"} <= set(schema.names) and "models" not in o else ["series_id"]
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields if f.name not in ("x", "y", "z", "series_id")}
        maps = {n: 1 for n, k in kinds.items() if k in numbers} | {n: int(o.get("steps", 1)) for n, k in kinds.items() if k in [f"array<{x}>" for x in numbers]}
        triple = lambda s, kind: tuple(kind(v) for v in s.split(","))
        models = json.loads(o["models"]) if "models" in o else None
        return VolumeWriter(_local(o["path"]), maps, key, triple(o["shape"], int), triple(o.get("sizes", "1,1,1"), float), float(o.get("step", 1.0)), models,
                            json.loads(o.get("notes", "{}")), overwrite)


def save_maps(rows: DataFrame, root: str, shape: tuple[int, int, int], sizes: tuple[float, float, float] = (1.0, 1.0, 1.0), step: float = 1.0, steps: int = 1,
              notes: dict[str, dict] | None = None, models: list[dict] | None = None) -> list[str]:
    """Write every map column of rows to <root>_desc-<column>_map.nii with a JSON sidecar, overwriting; the files' names. Rows are dealt by
    ranges of cells, so that a task writes long runs."""
    spark = rows.sparkSession
    spark.dataSource.register(VolumeSource)
    key = ["z", "y", "x"] if {"x", "y", "z"} <= set(rows.columns) and models is None else ["series_id"]
    writer = rows.repartitionByRange(*key).sortWithinPartitions(*key).write.format(NAME).mode("overwrite").option("shape", ",".join(map(str, shape)))
    writer = writer.option("sizes", ",".join(map(str, sizes))).option("step", str(step)).option("steps", str(steps)).option("notes", json.dumps(notes or {}))
    (writer.option("models", json.dumps(models)) if models else writer).save(root)
    names = [c for c, k in rows.dtypes if c not in ("x", "y", "z", "series_id") and k not in ("string", "boolean")]
    return [f"{_local(root)}_desc-{n}_map{'.dtseries' if models else ''}.nii" for n in names]


def load(spark: SparkSession, path: str, gray: bool = False) -> DataFrame:
    """Rows of volumes, or of grayordinates. Filters on series_id keep cells unread if the session has spark.sql.python.filterPushdown.enabled."""
    spark.dataSource.register(VolumeSource)
    bounds = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).option("gray", str(gray).lower()).option("bounds", bounds).load(path)
