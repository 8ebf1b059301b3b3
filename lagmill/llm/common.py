"""Helpers shared by the training-data operators: text expressions and star labels, beside the library's work folder and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagmill.operators.graphs import components
from lagmill.sources.tables import discard, materialize, new_path, remove, scratch, table, work_dir

__all__ = ["components", "discard", "let", "lower_ascii", "materialize", "new_path", "read_table", "remove", "scratch", "sent", "split_words", "star_labels", "work_dir"]

#: Fixed value: the ASCII white space that separates words.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def sent(df: DataFrame, most: int) -> DataFrame:
    """df, a written table, to be sent to all tasks if it has at most so many rows; else left to the planner. It makes no difference to results."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row; a plain column reference may be inlined into a lambda and recomputed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. The built-in lower() is right, and faster, for pure ASCII."""
    slow = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def split_words(text: Column, between: str) -> Column:
    """The non-empty pieces of text between matches of the pattern."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between), "")


def star_labels(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): each id's smallest neighbour or itself, then that one's. Ids with one label are connected, the reverse need not hold:
    one cheap step towards components()."""
    both = edges.select(F.col(a).alias("id"), F.col(b).alias("o")).unionByName(edges.select(F.col(b).alias("id"), F.col(a).alias("o")))
    first = materialize(both.groupBy("id").agg(F.min("o").alias("o")).select("id", F.least("id", "o").alias("m")), "cc-first")
    return first.join(first.toDF("m", "component"), "m").select("id", "component")
