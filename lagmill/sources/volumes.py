"""NIfTI-1 volumes as a source: one row per voxel with its whole history, and headers without data."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: NIfTI-1 data type codes.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
#: Seconds per unit of the header's time unit codes: seconds, milliseconds, microseconds.
TIME_UNITS = {0: 1.0, 8: 1.0, 16: 1e-3, 24: 1e-6}
HEADER = "path string, nx int, ny int, nz int, nt int, dx double, dy double, dz double, tr double, dtype string"


def parse_header(data: bytes) -> dict:
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", data[:4])[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    dim = [max(1, d) for d in struct.unpack(order + "8h", data[40:56])]
    pix = struct.unpack(order + "8f", data[76:108])
    code = struct.unpack(order + "h", data[70:72])[0]
    offset, slope, inter = struct.unpack(order + "3f", data[108:120])
    return {
        "shape": tuple(dim[1:5]), "sizes": tuple(map(float, pix[1:4])), "tr": pix[4] * TIME_UNITS.get(data[123] & 56, 1.0), "dtype": order + TYPES[code],
        "offset": int(offset), "slope": slope or 1.0, "inter": inter,
    }


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, dimensions, voxel sizes, step (seconds) and number type of every volume file."""

    def headers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                h = parse_header(gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c)
                rows.append((p, *h["shape"], *h["sizes"], h["tr"], np.dtype(h["dtype"]).name))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HEADER.split(", ")])

    return _files(spark, path).mapInPandas(headers, HEADER)


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """path, series_id (x fastest), x, y, z, values: scaled samples in time order, NaN as 0. A file is decoded in one task, slab by slab."""

    def voxels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                raw = gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c
                h = parse_header(raw)
                nx, ny, nz, nt = h["shape"]
                grid = np.frombuffer(raw, h["dtype"], nx * ny * nz * nt, h["offset"]).reshape(nt, nz, ny, nx)
                for z in range(nz):
                    slab = np.nan_to_num(grid[:, z].reshape(nt, -1).T * float(h["slope"]) + float(h["inter"]))
                    x, y = np.tile(np.arange(nx), ny), np.repeat(np.arange(ny), nx)
                    yield pd.DataFrame({"path": p, "series_id": z * nx * ny + y * nx + x, "x": x, "y": y, "z": z, "values": list(slab)})

    return _files(spark, path).mapInPandas(voxels, "path string, series_id long, x int, y int, z int, values array<double>")


def encode_volume(values: np.ndarray, sizes: tuple[float, float, float], tr: float) -> bytes:
    """One float32 NIfTI-1 file of an array (x, y, z, t)."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 4, *values.shape, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1.0, *sizes, tr, 1.0, 1.0, 1.0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[123] = 2 | 8
    head[344:348] = b"n+1\0"
    return bytes(head) + np.asarray(values, "<f4").transpose(3, 2, 1, 0).tobytes()
