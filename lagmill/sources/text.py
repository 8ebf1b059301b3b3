"""Text sources and sinks of time courses: TSV with JSON sidecar, labelled TSV and CSV, plain vectors, design matrices, motion files, labels
and key/value files. Every reader gives a long table (t, name, value) or a small named one; files are read by Spark's readers, so
paths may be globs and on any store."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: columns of a motion parameter file, in order.
MOTION = ("RotX", "RotY", "RotZ", "X", "Y", "Z")


def columns_of(spec: str) -> list[int]:
    """Numbers named by 'a,b-c,d': sorted, each once."""
    out: set[int] = set()
    for part in spec.split(","):
        first, _, last = part.strip().partition("-")
        out |= set(range(int(first), int(last or first) + 1))
    return sorted(out)


def file_spec(spec: str) -> tuple[str, str | None]:
    """'path:columns' -> (path, columns); a colon that starts a scheme belongs to the path."""
    found = re.fullmatch(r"(.+?):([^/\\:]+)", spec)
    return (found[1], found[2]) if found else (spec, None)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The non-empty lines of text files as t (from 0 in file order), value. A time course file is small; its lines are numbered in one task."""
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("_id", F.monotonically_increasing_id())
    return rows.select((F.row_number().over(Window.orderBy("_id")) - 1).alias("t"), F.trim("value").alias("value"))


def _number(c: Column) -> Column:
    """A double; what is missing or no number counts as 0, as in the formats read here."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)


def _long(rows: DataFrame, cells: Column, names: list[str] | None) -> DataFrame:
    out = rows.select("t", F.posexplode(cells).alias("i", "_c"))
    label = F.get(F.array(*map(F.lit, names)), "i") if names else F.concat(F.lit("col_"), F.lpad(F.col("i").cast("string"), 2, "0"))
    return out.select("t", label.alias("name"), _number(F.col("_c")).alias("value")).where("name is not null")


def read_sidecar(spark: SparkSession, path: str) -> dict:
    """The dictionary of one JSON file; empty if there is none."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()  # one small file
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    return json.loads(rows[0][0]) if rows else {}


def read_timeseries(spark: SparkSession, root: str) -> tuple[DataFrame, float, float]:
    """(t, name, value), rate and start of root.tsv(.gz) with root.json: names from its Columns, else col_00 ...; rate 1 and start 0
    where it doesn't say. A header line is passed over."""
    info = read_sidecar(spark, f"{root}.json")
    rows = lines(spark, f"{root}.tsv*")
    cells = F.split("value", "\t")
    first = rows.where("t = 0").select(F.get(cells, F.lit(0)).try_cast("double").isNull()).first()
    if first and first[0]:
        rows = rows.where("t > 0").withColumn("t", F.col("t") - 1)
    return _long(rows, cells, info.get("Columns")), float(info.get("SamplingFrequency", 1.0)), float(info.get("StartTime", 0.0))


def write_timeseries(samples: DataFrame, root: str, names: list[str], rate: float, start: float = 0.0) -> None:
    """(t, name, value) as root.tsv.gz, one column a name in the given order, and root.json. The rows are one file in order of t."""
    spark = samples.sparkSession
    wide = samples.groupBy("t").pivot("name", names).agg(F.first("value")).repartitionByRange(1, "t").sortWithinPartitions("t")
    wide.select(*names).write.option("sep", "\t").option("compression", "gzip").csv(f"{root}.tsv.gz")
    info = json.dumps({"SamplingFrequency": rate, "StartTime": start, "Columns": names})
    spark.createDataFrame([(info,)], "value string").coalesce(1).write.text(f"{root}.json")


def read_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(t, name, value) of a delimited file; its first line names the columns unless it starts with a number."""
    rows = lines(spark, path)
    cells = F.split("value", re.escape(sep))
    head = rows.where("t = 0").select(cells.alias("c")).first()
    names = None
    if head and re.fullmatch(r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*", head["c"][0]) is None:
        names = [c.strip() for c in head["c"]]
        rows = rows.where("t > 0").withColumn("t", F.col("t") - 1)
    return _long(rows, cells, names)


def read_vectors(spark: SparkSession, path: str, spec: str | None = None, skip: int = 0) -> DataFrame:
    """(t, name, value) of a text matrix, columns parted by white space or commas; spec picks columns, the first `skip` lines are passed over, and
    so is a first line without a number."""
    rows = lines(spark, path).where(F.col("t") >= skip)
    cells = F.split("value", "[\\s,]+")
    head = rows.orderBy("t").select("t", F.get(cells, F.lit(0)).try_cast("double").isNull().alias("text")).first()
    if head:
        rows = rows.where(F.col("t") >= head["t"] + int(head["text"])).withColumn("t", F.col("t") - head["t"] - int(head["text"]))
    out = _long(rows, cells, None)
    return out.where(F.col("name").isin([f"col_{i:02d}" for i in columns_of(spec)])) if spec else out


def read_design(spark: SparkSession, path: str) -> DataFrame:
    """(t, name, value) of a design matrix file: what follows its /Matrix line."""
    rows = lines(spark, path)
    start = rows.where(F.col("value").startswith("/Matrix")).agg(F.min("t").alias("m"))
    body = rows.crossJoin(F.broadcast(start)).where(F.col("t") > F.col("m")).select((F.col("t") - F.col("m") - 1).alias("t"), "value")
    return _long(body, F.split("value", "\\s+"), None)


def read_motion(spark: SparkSession, path: str) -> DataFrame:
    """Wide table t, the six motion parameters and max and min of translations and rotations."""
    wide = _long(lines(spark, path), F.split("value", "\\s+"), list(MOTION)).groupBy("t").pivot("name", list(MOTION)).agg(F.first("value"))
    extremes = {f"{n}{k}": f(*cols) for k, cols in (("rot", MOTION[:3]), ("trans", MOTION[3:])) for n, f in (("max", F.greatest), ("min", F.least))}
    return wide.withColumns(extremes)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """seq, start, duration, value of a three-column event file (value 1 if there are two columns)."""
    c = F.split("value", "[\\s,]+")
    return lines(spark, path).select(
        F.col("t").alias("seq"), _number(F.get(c, F.lit(0))).alias("start"), _number(F.get(c, F.lit(1))).alias("duration"),
        F.coalesce(F.get(c, F.lit(2)).try_cast("double"), F.lit(1.0)).alias("value"),
    )


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """key, value of lines 'key: value', 'key<tab>value' or 'key value'."""
    return lines(spark, path).select(F.regexp_extract("value", r"^([^:\t ]+)", 1).alias("key"), F.regexp_extract("value", r"^[^:\t ]+[:\t ]+(.*)$", 1).alias("value"))


def slice_times(spark: SparkSession, path: str) -> DataFrame:
    """slice, time of a JSON file's SliceTiming, or of a text file with one time a line."""
    if path.endswith(".json"):
        return spark.read.json(path, multiLine=True).select(F.posexplode("SliceTiming").alias("slice", "time"))
    return lines(spark, path).select(F.col("t").alias("slice"), _number(F.col("value")).alias("time"))
