"""Tables as sources, and the two layouts of series: arrays (one row a series) and samples (one row a sample)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
#: Paths of tables that materialize() wrote and nothing has deleted.
_written: dict[str, None] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a local master may do without: it gets a temporary folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lagmill-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, parts: int | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and outlives lost executors. parts: in so many tasks and files
    at most, for a table known to be small; it has no effect where there are fewer."""
    path = new_path(df.sparkSession, label)
    if parts:
        df = df.coalesce(parts)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lagmill_path = path
    _written[path] = None
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written.pop(path, None)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_lagmill_path", None):
            remove(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at its end whatever tables were written inside, but for those put into the list it gives."""
    before, keep = set(_written), []
    yield keep
    kept = {getattr(df, "_lagmill_path", None) for df in keep}
    for path in [p for p in _written if p not in before and p not in kept]:
        remove(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_samples(series: DataFrame) -> DataFrame:
    """(other columns, values) -> (other columns, t, v), t from 0."""
    rest = [c for c in series.columns if c != "values"]
    return series.select(*rest, F.posexplode("values").alias("t", "v"))


def to_series(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, v) -> (keys, values) in order of t. A series is one row, as everywhere here."""
    ordered = F.sort_array(F.collect_list(F.struct("t", "v")))
    return samples.groupBy(*keys).agg(F.transform(ordered, lambda x: x["v"]).alias("values"))


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as series: series_id, label, values."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("series_id"), "label", values.alias("values"))


def on_grid(series: DataFrame, side: int = 8) -> DataFrame:
    """series with grid coordinates counted off from series_id: x fastest, then y, then z."""
    i = F.col("series_id")
    return series.select("*", (i % side).cast("int").alias("x"), (F.floor(i / side) % side).cast("int").alias("y"), F.floor(i / (side * side)).cast("int").alias("z"))
