"""Mixing sources to target weights: whole copies by repetition rate plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagmill.llm.common import WORD, materialize

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Rows of a source and size class that one task numbers, at most about.
BUCKET_ROWS = 1_000_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone (52 bits of an MD5)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Per source of (source, size): source_size and target.

    Sources in code point order, null last, weigh weights[0], weights[1], ... in turn; targets share the sum of sizes in
    proportion, stop at most times the source's size, and the excess goes to the others by weight. With sources ordered by cap / weight,
    the level (target per weight) is the largest of what each source would see if all before it were capped.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * most).cast("double"))
    ahead = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0))
    per = per.withColumn("level", left / weight_left)
    return per.select("source", "source_size", F.least("cap", F.col("weight") * F.max("level").over(everything)).alias("target"))


def _strata(rows: DataFrame, digits: int) -> DataFrame:
    """rows with _s (source, not null), _c (size class: whole part of the size's root), _k (hash of the id) and _p (its first digits)."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("_k", digest)
    return rows.withColumn("_c", F.floor(F.sqrt(F.col("size").cast("double")))).withColumn("_p", F.substring("_k", 1, digits))


def with_copies(rows: DataFrame, sizes: DataFrame, seed: str = "mix") -> DataFrame:
    """rows (doc_id, source, size, th and any others) with source_size, target and copies, sizes being a written table of the same
    doc_id, source, size and th (text hash).

    copies is floor(rate) whole copies, rate = target / source_size, plus a Bernoulli copy with probability equal to the fraction. The draws of
    one source depend on each other, so that their sum stays near its expectation even for few or very unequal documents: in order of size
    class and hash of the id (then id, size and text hash), document i takes a copy when u + i * fraction passes a whole number, u being the
    source's hash-seeded uniform number. A document that comes or goes may hence change draws of the larger documents of its source.
    Positions are numbered in buckets of a source, size class and hash prefix, and offset by the counts of the buckets before.
    """
    digits = max(1, ceil(log(max(1, sizes.count() / BUCKET_ROWS), 16)))
    ahead = Window.partitionBy("_s").orderBy("_c", "_p").rowsBetween(Window.unboundedPreceding, -1)
    buckets = _strata(sizes, digits).groupBy("_s", "_c", "_p", "source").agg(F.count(F.lit(1)).alias("_n"))
    buckets = buckets.withColumn("_off", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    targets = source_targets(sizes).withColumnRenamed("source", "_source")
    buckets = buckets.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source", "_n")
    order = ["_k", "doc_id", "size", "th", *([F.xxhash64("_row")] if "_row" in rows.columns else [])]
    placed = _strata(rows, digits)
    placed = placed.withColumn("_i", F.row_number().over(Window.partitionBy("_s", "_c", "_p").orderBy(*order))).join(buckets, ["_s", "_c", "_p"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = placed.withColumn("_f", rate - F.floor(rate)).withColumn("_u", uniform(F.col("source"), seed)).withColumn("_i", F.col("_off") + F.col("_i"))
    extra = F.floor(F.col("_u") + F.col("_i") * F.col("_f")) - F.floor(F.col("_u") + (F.col("_i") - 1) * F.col("_f"))
    return placed.withColumn("copies", (F.floor(rate) + extra).cast("int")).drop("_s", "_c", "_p", "_k", "_i", "_off", "_f", "_u")


def _sizes(docs: DataFrame) -> DataFrame:
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("th")), "mix-sizes")


def mix_plan(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Per document (doc_id, source, text): size in words, source_size, target of its source, copies and taken = size * copies.

    Null texts have size 0. Null sources are one source, last in order. A null doc_id hashes as the empty string; rows with one
    doc_id each have their own place and draw, in order of size and text hash. An empty table gives no rows. Other columns are ignored.
    """
    rows = _sizes(docs)
    plan = with_copies(rows, rows, seed)
    return plan.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every row of docs as often as mix_plan says, columns unchanged."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("th"))
    copied = with_copies(rows, _sizes(docs), seed).where("copies > 0")
    return copied.select("_row", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")
