"""Sharding by jump consistent hashing: document id and shard count alone decide, without a ring table."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagmill.llm.common import let, materialize

SHARDS = 40
#: Rows that one task numbers at a time, about; a shard with more is numbered in sub-buckets.
BUCKET_ROWS = 100_000


def jump_hash(key: Column, shards: int) -> Column:
    """Struct (shard, grown, digest) of a string key: its shard of `shards`, its shard of one more, and the MD5 that starts its chain.

    Jump consistent hashing with successive MD5s as the key's random numbers: from bucket b the key next moves when the
    count passes j = floor((b + 1) * 2**31 / (r + 1)), r the digest's upper 31 bits. j grows by one at least, so
    shards + 1 steps suffice; finished keys pass through.
    """
    start = F.struct(F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"), key.alias("chain"))

    def step(acc: Column, _: Column) -> Column:
        def moved(digest: Column) -> Column:
            r = F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 1)
            j = F.floor((acc["j"] + 1) * (F.lit(2.0**31) / (r + 1).cast("double")))
            return F.struct(
                j.cast("long").alias("j"),
                F.when(acc["j"] < shards, acc["j"]).otherwise(acc["shard"]).alias("shard"),
                acc["j"].alias("grown"),
                digest.alias("chain"),
            )

        return F.when(acc["j"] < shards + 1, let(F.md5(acc["chain"]), moved)).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of docs (doc_id, text): size (UTF-8 bytes plus 16), text_crc32, law 'key', shard, slot and grown_shard.

    Slots number a shard's rows from 0 without gaps, ordered by the MD5 of the id, then id, checksum and size. Shards are numbered
    in sub-buckets by the digest's first digits, with as many as keep a bucket small, and offsets from the bucket counts.
    A null text is empty; a null doc_id is the empty key; repeated ids go to one shard and get a slot each. An empty table gives
    no rows. Other columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(key).alias("order_key"),
        jump_hash(key, shards).alias("h"),
    ).select("doc_id", "size", "text_crc32", "order_key", F.col("h.shard").cast("int").alias("shard"), F.col("h.grown").cast("int").alias("grown_shard"))
    rows = materialize(rows, "shard-rows")
    digits = max(2, ceil(log(max(1, rows.count() / (shards * BUCKET_ROWS)), 16)))
    rows = rows.withColumn("bucket", F.substring("order_key", 1, digits))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    place = Window.partitionBy("shard", "bucket").orderBy("order_key", "doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(place))
        .join(offsets, ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )
