"""Spelling variants by permuterm rotations: words one character apart share a rotation but for the character that differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagmill.llm.common import discard, lower_ascii, materialize

#: The letters of words, and the mark behind a word's end, which is none of them.
_RUN, END = "[A-Za-z\\u00C0-\\u00FF]+", "$"
#: Characters of a word and occurrences that make it count; how much more often its form must occur; one run in so many loses a letter.
LEAST_LENGTH, LEAST_COUNT, RATIO, DAMAGE = 5, 3, 2, 97


def damaged(doc_id: Column, run: Column) -> Column:
    """run without one code point, where DAMAGE divides the CRC-32 of `doc_id:run`; else run."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) over all rows of docs (doc_id, text): the runs of letters, A-Z lower-cased, some of them damaged (see damaged()), that
    have at least so many characters and occurrences. Null and empty texts have none, repeated rows count each."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(_RUN), F.lit(0))).alias("run"))
    words = runs.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).filter(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, skips, first, word, n): every rotation of each word with END behind it. Where skips, the rotation ends in one of the word's
    characters and prefix leaves it out; else prefix is a whole rotation. first: the skipped character doesn't repeat the one before it.

    Words that differ by one replaced character share the prefix that skips it; a word that lacks one character of another has, as a
    whole rotation, the prefix where the other skips it. In a run of equal characters `first` marks the one place that stands for all.
    """
    n, at = F.char_length("word"), F.col("at")
    tail = F.concat(F.substr("word", at + 1), F.lit(END))  # from character `at`, counted from 0, to the end mark
    head = F.substr("word", F.lit(1), at)
    whole = words.select("word", "n", F.explode(F.sequence(F.lit(0), n)).alias("at")).select(
        F.concat(tail, head).alias("prefix"), F.lit(False).alias("skips"), F.lit(False).alias("first"), "word", "n")
    here, before = F.substr("word", at + 1, F.lit(1)), F.substr("word", at, F.lit(1))
    skipping = words.select("word", "n", F.explode(F.sequence(F.lit(0), n - 1)).alias("at")).select(
        F.concat(F.substr("word", at + 2), F.lit(END), head).alias("prefix"), F.lit(True).alias("skips"),
        ((at == 0) | (here != before)).alias("first"), "word", "n")
    return whole.unionByName(skipping)


def neighbours(words: DataFrame) -> DataFrame:
    """Per row of words (word, n) and shared rotation: word, n, links (how many words it links to there) and best (less, near: minus its
    count and the word, of the most frequent of them, ties by code point). Every pair of words one character apart has exactly one
    rotation, so a word's links add up to the number of its near words.

    Rotations are sorted by prefix and scanned group by group. Words of a group differ in the one character they skip, so it has no more
    of them than there are letters (90), and one whole word; it is scanned without making its pairs.
    """
    group = Window.partitionBy("prefix")
    scan = group.orderBy(F.col("skips").desc(), F.col("n").desc(), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-F.col("n")).alias("less"), F.col("word").alias("near"))
    found = rotations(words).select(
        "*",
        F.count_if("skips").over(group).alias("skipping"), F.count_if("first").over(group).alias("firsts"),
        F.first(me).over(scan).alias("one"), F.nth_value(me, 2).over(scan).alias("two"),
        F.min(F.when(F.col("first"), me)).over(group).alias("first_one"), F.max(F.when(~F.col("skips"), me)).over(group).alias("whole"),
    )
    other = F.when(F.col("one.near") != F.col("word"), F.col("one")).when(F.col("skipping") > 1, F.col("two"))
    lacking = F.when(F.col("first"), F.col("whole"))
    links = F.when(F.col("skips"), F.col("skipping") - 1 + F.col("whole").isNotNull().cast("long") * F.col("first").cast("long")).otherwise(F.col("firsts"))
    best = F.when(F.col("skips"), F.least(other, lacking)).otherwise(F.col("first_one"))
    return found.select("word", "n", links.alias("links"), best.alias("best")).filter(F.col("links") > 0)


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per row of words (word, n), words distinct: word, n, n_near, form and form_n: its most frequent near word (ties: smallest by code
    point) if that occurs ratio times as often at least, else null."""
    near = neighbours(words).groupBy("word").agg(F.sum("links").alias("n_near"), F.min("best").alias("best"))
    joined = words.join(near.select("word", "n_near", "best"), "word", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """formed (word, form, other columns), a written table, with root: the word that following forms from it ends at. Counts grow along
    forms, so chains end; each round doubles the steps taken, and rounds end once no root has a form."""
    links = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    reached = materialize(links, "spelling-roots")
    while True:
        onward = reached.join(reached.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        moved = materialize(onward.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        discard(reached)
        reached = moved.drop("moved")
        reached._lagmill_path = moved._lagmill_path
        if moved.filter("moved").isEmpty():
            return formed.join(reached, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """Per word of the texts of docs (doc_id, text): word, form (the near word it is a variant of, or null), root (the word that forms lead
    to; itself without a form), n, n_near and form_n (null without a form). Near: one code point inserted, deleted or replaced.

    Counting combines words in each task before it shuffles them, so frequent words are no hot keys; rotations are dealt by prefix, whose
    groups have at most 91 rows. Null and empty texts have no words, repeated rows count each, a null doc_id counts as an empty one, an
    empty table gives no rows, other columns are ignored; texts are read whole.
    """
    words = materialize(word_counts(docs, least_length, least_count), "spelling-words")
    formed = materialize(forms(words, ratio), "spelling-forms")
    discard(words)
    return roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
