"""Corpus pipeline over documents: classify quality, drop near-duplicates and benchmark passages, mix the sources, shard.

Each stage is written as Parquet and reread as the next one's input. A document is a row. Decisions on it are joined back by doc_id and
text hash, so rows that share a doc_id but not a text are told apart. Stages ignore columns beside COLUMNS; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagmill.llm.common import discard, materialize, read_table, scratch, sent
from lagmill.llm.decontaminate import contamination
from lagmill.llm.mixing import mix
from lagmill.llm.near_dedup import near_duplicates
from lagmill.llm.quality_classifier import score_column, train
from lagmill.llm.sharding import shard

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Names of rows with decisions that are sent to all tasks, at most (some 20 MB); more are joined by a shuffle of the texts.
MOST_SENT = 200_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good. Null and empty texts are scored like any other; repeated rows share their score."""
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).where(score_column(model, F.col("text")) >= 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.

    Rows equal in doc_id and text are one document, of which one row stays. Rows that share a doc_id with another text go by a hash
    of both instead, so that neither falls with the other. Null ids can't be compared: their rows stay, once per text.
    Null and empty texts are like no other and stay.
    """
    docs, th = docs.select(*COLUMNS), F.xxhash64("text")
    copies = materialize(docs.groupBy("doc_id", th.alias("_th")).agg(F.count(F.lit(1)).alias("n")), "pipeline-copies")
    shared = copies.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_shared"))
    shared = sent(materialize(shared, "pipeline-shared"), MOST_SENT)

    def named(rows: DataFrame) -> DataFrame:
        rows = rows.join(shared, F.col("doc_id") == F.col("_shared"), "left")
        return rows.withColumn("_name", F.when(F.col("_shared").isNull(), F.col("doc_id").cast("long")).otherwise(F.xxhash64("doc_id", "_th"))).drop("_shared")

    near = near_duplicates(named(docs.withColumn("_th", th)).select(F.col("_name").alias("doc_id"), "text"))
    gone = near.where("not kept").select(F.col("doc_id").alias("_name"), F.lit(True).alias("gone")).distinct()
    marks = named(copies).join(gone, "_name", "left").where("gone or n > 1").select(F.col("doc_id").alias("_id"), F.col("_th").alias("_t"), "gone")
    marks = sent(materialize(marks, "pipeline-marks"), MOST_SENT)
    rows = docs.withColumn("_th", th)
    rows = rows.join(marks, rows["doc_id"].eqNullSafe(marks["_id"]) & (F.col("_th") == F.col("_t")), "left").where("gone is null")
    once = rows.where("_t is not null").dropDuplicates(["doc_id", "_th"])
    return rows.where("_t is null").unionByName(once).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null and empty texts hold none and stay, rows with a null doc_id are judged like others."""
    found = contamination(docs, read_table(spark, sf_dir, "benchmark")).where("contaminated")
    dropped = found.select(F.col("doc_id").alias("_id"), F.col("th").alias("_t")).distinct()
    dropped, docs = sent(materialize(dropped, "pipeline-dropped"), MOST_SENT), docs.select(*COLUMNS)
    return docs.join(dropped, docs["doc_id"].eqNullSafe(dropped["_id"]) & (F.xxhash64("text") == F.col("_t")), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for. Null sources are one source; repeated rows each have their own draw."""
    return mix(docs.select(*COLUMNS))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard, slot and grown shard of every row; copies of a document share its shard, null ids are one key."""
    return shard(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The trained trees of the first stage have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage's output is a written table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as kept:  # a stage's own tables go once its output is written
            docs = materialize(stage(spark, before, sf_dir), f"pipeline-{name}")
            kept.append(docs)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
