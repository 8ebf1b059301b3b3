"""Benchmark decontamination with a distributed positional inverted index over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagmill.llm.common import lower_ascii, materialize, sent, split_words

WINDOW = 10
#: Words that the two rarest terms of an item may stand apart in a proximity match.
NEAR = 8
#: Postings of one term that one task reads, about; those of a more frequent term are dealt to more tasks by their document.
HOT = 5_000_000
#: Consecutive words of a window by which the index tells whether a position can be part of a phrase.
GRAM = 4
#: Rows of a table of benchmark terms, or of runs of them, that are sent to all tasks, at most (some 50 MB); larger ones are joined by shuffles.
MOST_SENT = 500_000
#: Fixed value: what separates the words of documents and items, once A-Z are lower case.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
ROW = ("doc_id", "th")


def item_words(text: Column) -> Column:
    return split_words(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN)


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows of items (item_id, text): win (words joined by spaces), len, items (sorted ids of the items that hold it) and
    set, a name of that list."""
    n = F.size("w")
    starts = F.when(n >= width, F.sequence(F.lit(1), n - width + 1)).when(n > 0, F.array(F.lit(1)))
    return (
        items.select(F.col("item_id").cast("string").alias("item_id"), item_words(F.col("text")).alias("w"))
        .select("item_id", "w", F.explode(starts).alias("s"))
        .select("item_id", F.array_join(F.slice("w", F.col("s"), F.lit(width)), " ").alias("win"))
        .groupBy("win")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        .withColumns({"len": F.size(F.split("win", " ")), "set": F.sha2(F.to_json("items"), 256)})
    )


def words_table(docs: DataFrame) -> DataFrame:
    """doc_id, th (text hash: with doc_id it names a row), n_words and the array of words, written once: the only pass that splits texts."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), item_words(F.col("text")).alias("w"))
    return materialize(rows.withColumn("n_words", F.size("w").cast("long")), "decon-words")


def term_frequencies(words: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of the terms occurs in all documents; only those that occur."""
    tokens = words.select(F.explode("w").alias("term")).join(sent(terms, MOST_SENT), "term", "left_semi")
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def window_grams(windows: DataFrame) -> DataFrame:
    """gram, width: all runs of GRAM words of the windows, and shorter windows whole; a window of one word gives none."""
    w, k = F.split("win", " "), F.least(F.col("len"), F.lit(GRAM))
    runs = F.transform(F.sequence(F.lit(1), F.col("len") - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
    return windows.where("len > 1").select(F.explode(runs).alias("gram"), k.alias("width")).distinct()


def positional_index(words: DataFrame, terms: DataFrame, grams: DataFrame) -> DataFrame:
    """The inverted index: term, doc_id, th and the sorted positions of the term in that row.

    It holds every position of the given terms, and the positions of every term where one of the grams (gram, width; a written table) occurs word
    for word: a position outside of them all can be part of no phrase that the grams make up, so it is not stored. Postings of frequent
    words thus stay in proportion to what phrases can use.
    """
    tokens = words.select(*ROW, "w", F.posexplode("w").alias("pos", "term"))
    found = tokens.join(sent(terms, MOST_SENT).select("term", F.lit(True).alias("listed")), "term", "left")
    widths = sorted(r[0] for r in grams.select("width").distinct().collect())  # GRAM - 1 numbers at most
    run = lambda k: F.array_join(F.slice("w", F.col("pos") + 1, k), " ")
    found = found.select(*ROW, "pos", "term", "listed", *(run(k).alias(f"g{k}") for k in widths))
    for k in widths:
        some = sent(grams.where(F.col("width") == k), MOST_SENT).select(F.col("gram").alias(f"g{k}"), F.lit(True).alias(f"hit{k}"))
        found = found.join(some, f"g{k}", "left")
    one = lambda pos, term: F.struct(pos.alias("pos"), term.alias("term"))
    none = F.array().cast("array<struct<pos:int,term:string>>")
    spread = lambda k: F.when(F.col(f"hit{k}"), F.transform(F.split(f"g{k}", " "), lambda t, i: one(F.col("pos") + i, t))).otherwise(none)
    hit = F.coalesce("listed", F.lit(False))
    for k in widths:
        hit = hit | F.coalesce(f"hit{k}", F.lit(False))
    posts = F.concat(F.when(F.col("listed"), F.array(one(F.col("pos"), F.col("term")))).otherwise(none), *map(spread, widths))
    return found.where(hit).select(*ROW, F.explode(posts).alias("p")).groupBy(*ROW, "p.term").agg(F.sort_array(F.collect_set("p.pos")).alias("positions"))


def _ranked(windows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Windows whose words all occur in the corpus: win, len and terms, their (n, term, offset) from the rarest on."""
    words = windows.select("win", "len", F.posexplode(F.split("win", " ")).alias("offset", "term"))
    known = words.join(frequencies, "term").groupBy("win", "len").agg(F.array_sort(F.collect_list(F.struct("n", "term", "offset"))).alias("terms"))
    return known.where(F.size("terms") == F.col("len"))


def _bucket(count: Column) -> Column:
    """Part of a term's postings to which a row belongs, of one part per HOT postings."""
    return F.pmod(F.xxhash64(*ROW), F.ceil(count / HOT).cast("int")).cast("int")


def phrase_matches(index: DataFrame, windows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """doc_id, th, start, len, win of every place where a window occurs word for word, by intersecting posting lists.

    A list adjusted by its term's offset holds the starts that the term allows. The rarest term's adjusted list gives the candidates; they
    meet the lists of their own document once, by row, and are intersected with those of the other terms from the rarest on. Lists of
    frequent terms are dealt by document, so no list has to pass through one task, and a document's lists are no longer than its text.
    """
    ranked = materialize(_ranked(windows, frequencies), "decon-ranked")
    adjusted = lambda positions, offset: F.filter(F.transform(positions, lambda p: p - offset), lambda s: s >= 0)
    first = ranked.select("win", F.col("terms")[0]["n"].alias("n"), F.col("terms")[0]["term"].alias("term"), F.col("terms")[0]["offset"].alias("offset"))
    first = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / HOT).cast("int") - 1))).drop("n")
    hot = frequencies.where(F.col("n") > HOT)
    dealt = index.join(hot, "term", "left").withColumn("part", F.coalesce(_bucket(F.col("n")), F.lit(0))).drop("n")
    starts = dealt.join(sent(first, MOST_SENT), ["term", "part"]).select(*ROW, "win", adjusted(F.col("positions"), F.col("offset")).alias("starts"))
    starts = materialize(starts.where(F.size("starts") > 0), "decon-starts")

    lists = index.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("lists"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))
    # Windows' terms are some ten times as wide as a term.
    met = starts.join(lists, same).drop("d", "h").join(sent(ranked, MOST_SENT // 10), "win")
    listed = lambda t: adjusted(F.try_element_at("lists", t["term"]), t["offset"])
    left = F.aggregate(F.slice("terms", 2, F.size("terms")), F.col("starts"), lambda some, t: F.array_intersect(some, listed(t)))
    return met.select(*ROW, "win", "len", F.explode(left).alias("start"))


def rarest_pairs(items: DataFrame, frequencies: DataFrame) -> DataFrame:
    """item_id, first, second: the two rarest different terms of each item that occur in the corpus (ties: in order of the terms)."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), F.explode(F.array_distinct(item_words(F.col("text")))).alias("term"))
    order = F.array_sort(F.collect_set(F.struct("n", "term")))
    two = words.join(frequencies, "term").groupBy("item_id").agg(order.alias("o")).where(F.size("o") > 1)
    return two.select("item_id", F.col("o")[0]["term"].alias("first"), F.col("o")[1]["term"].alias("second"))


def proximity_matches(index: DataFrame, probes: DataFrame, distance: int = NEAR) -> DataFrame:
    """doc_id, th, item_id, first_pos, second_pos of all places where the two terms of a probe (item_id, first, second) stand at most
    `distance` words apart. Position cells of `distance` words make the comparison an equality join."""
    pairs = probes.select("first", "second").distinct()
    posts = index.select(*ROW, "term", F.explode("positions").alias("pos"))
    one = posts.join(pairs, posts["term"] == pairs["first"]).select(*ROW, "first", "second", F.col("pos").alias("first_pos"))
    two = posts.join(pairs, posts["term"] == pairs["second"]).select(
        F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("first").alias("f"), F.col("second").alias("s"), F.col("pos").alias("second_pos"))
    cell = F.floor(F.col("first_pos") / distance)
    one = one.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    two = two.withColumn("c", F.floor(F.col("second_pos") / distance))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")) & (F.col("first") == F.col("f")) & (F.col("second") == F.col("s"))
    near = one.join(two, same & (F.col("cell") == F.col("c"))).where(F.abs(F.col("first_pos") - F.col("second_pos")) <= distance)
    near = near.select(*ROW, "first", "second", "first_pos", "second_pos").distinct()
    return near.join(probes, ["first", "second"]).select(*ROW, "item_id", "first_pos", "second_pos")


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, distance: int = NEAR) -> DataFrame:
    """Per row of docs (doc_id, text): th (text hash), n_words, n_hit (words inside any occurrence of an item's window), n_items (items
    with an occurring window), item_ids (sorted strings), items_sha256, contaminated, and n_near (items whose two rarest terms stand at
    most `distance` words apart; a hint, it doesn't make a row contaminated).

    A window is `width` consecutive words of an item, or all words of a shorter one. Null and empty texts have no words; null item ids
    are left out of item_ids and n_near. Rows with equal doc_id and text get equal results. Without items nothing is contaminated; an
    empty docs table gives no rows. Texts of any length are indexed whole. Other columns are ignored.
    """
    items = items.select("item_id", "text")
    windows = materialize(item_windows(items, width), "decon-windows")
    rows = words_table(docs.select("doc_id", "text"))
    vocabulary = materialize(items.select(F.explode(item_words(F.col("text"))).alias("term")).distinct(), "decon-terms")
    frequencies = materialize(term_frequencies(rows, vocabulary), "decon-tf")
    probes = materialize(rarest_pairs(items.where("item_id is not null"), frequencies), "decon-probes")
    whole = probes.select(F.explode(F.array("first", "second")).alias("term")).unionByName(windows.where("len = 1").select(F.col("win").alias("term"))).distinct()
    whole = materialize(whole, "decon-whole")
    grams = materialize(window_grams(windows), "decon-grams")
    index = materialize(positional_index(rows, whole, grams), "decon-index")

    matches = materialize(phrase_matches(index, windows, frequencies), "decon-matches")
    places = matches.groupBy(*ROW, "start").agg(F.max(F.col("start") + F.col("len")).alias("stop"))
    before = Window.partitionBy(*ROW).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.lit(0)))
    hits = places.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy(*ROW).agg(F.sum("fresh").cast("long").alias("n_hit"))
    # Lists of items meet a row once, however many windows share them.
    sets = matches.join(windows.select("win", "set"), "win").select(*ROW, "set").distinct()
    named = sets.join(windows.select("set", "items").dropDuplicates(["set"]), "set").select(*ROW, F.explode("items").alias("item_id"))
    named = named.groupBy(*ROW).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    near = proximity_matches(index, probes, distance).groupBy(*ROW).agg(F.count_distinct("item_id").alias("n_near"))
    for name, table in (("n_hit", hits), ("item_ids", named), ("n_near", near)):
        rows = rows.join(table.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), name), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left").drop("d", "h")
    ids, n_hit = F.coalesce("item_ids", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        "doc_id", "th", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
