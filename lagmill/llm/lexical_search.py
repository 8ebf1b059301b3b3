"""Ranked lexical search: documents of a block are grouped by the mask of an item's terms that they hold, masks are scored best first."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagmill.llm.common import lower_ascii, materialize, split_words

#: Documents that an item gets.
K = 10
#: Fixed shape of the score: parts of a hundred that a document's length decides, and the units of a term's weight and share.
LENGTH_SHARE, WEIGHT_UNIT, SHARE_UNIT, SATURATION = 90, 1000, 1_000_000_000, 8
#: Terms of all items that are searched for in one pass; more items take more passes.
MOST_TERMS = 200_000
#: Bytes of a text whose terms are held at a time.
BLOCK = 1 << 20
#: Rows scored first; each further step takes twice as many.
FIRST_ROWS = 64
#: Fixed value: what separates terms is every ASCII character but digits and letters.
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Bytes of a UTF-8 text, separators to blanks and A-Z to a-z.
_FOLDED = bytes(c if c >= 128 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: Column) -> Column:
    """The terms of a text in order, lower-cased."""
    return split_words(lower_ascii(text), _BETWEEN)


def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, some at a time."""
    folded, at = text.translate(_FOLDED), 0
    while at < len(folded):
        end = folded.find(b" ", at + BLOCK)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n (its terms with repeats), terms (places in the vocabulary, ascending) and tfs (their
    occurrences). The vocabulary is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(vocabulary)})
    kind = docs.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        for batch in batches:
            sizes, found, times = [], [], []
            for text in batch.column(1):
                n, hits = 0, []
                for some in _blocks(text.as_py()):
                    n += len(some)
                    hits.append(np.array([place[t] for t in some if t in place], np.int32))
                which, tf = np.unique(np.concatenate(hits) if hits else np.zeros(0, np.int32), return_counts=True)
                sizes.append(n)
                found.append(which)
                times.append(tf)
            ends = pa.array(np.cumsum([0] + [len(x) for x in found]), pa.int32())
            flat = [pa.array(np.concatenate(x) if x else np.zeros(0), t) for x, t in ((found, pa.int32()), (times, pa.int64()))]
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), *(pa.ListArray.from_arrays(ends, x) for x in flat)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    return rows.mapInArrow(counted, f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>")


class Block:
    """Postings of some documents, by document and as bitmaps by term."""

    def __init__(self, batch: pa.RecordBatch, total: int, length: int) -> None:
        lists = batch.column(2)
        starts = lists.offsets.to_numpy().astype(np.int64)
        self.ends = starts - starts[0]
        self.term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.size = batch.num_rows
        n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * total) // max(length, 1)
        self.doc = np.repeat(np.arange(self.size), np.diff(self.ends))
        self.share = (SHARE_UNIT * tf) // (1000 * tf + SATURATION * m[self.doc])
        # bitmaps of the terms that occur: bit d of bits[k] tells whether document d holds here[k]
        self.here, k = np.unique(self.term, return_inverse=True)
        self.bits = np.zeros((len(self.here), (self.size + 7) // 8), np.uint8)
        np.bitwise_or.at(self.bits, (k, self.doc >> 3), (128 >> (self.doc & 7)).astype(np.uint8))
        self.best = np.zeros(len(self.here), np.int64)
        np.maximum.at(self.best, k, self.share)
        self.place = batch.column(0)

    def groups(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct masks as booleans by term, the mask of each document), for the terms whose bitmaps are in these rows."""
        words = -(-len(rows) // 64)
        held = np.unpackbits(self.bits[rows], axis=1, count=self.size)  # terms x documents
        packed = np.zeros((self.size, 8 * words), np.uint8)
        packed[:, : -(-len(rows) // 8)] = np.packbits(held, axis=0).T
        keys = np.ascontiguousarray(packed).view(np.uint64)
        group = np.zeros(self.size, np.int64)
        for w in range(words):
            _, part = np.unique(keys[:, w], return_inverse=True)
            _, group = np.unique(group * self.size + part, return_inverse=True)
        first = np.zeros(int(group.max()) + 1, np.int64)
        first[group] = np.arange(self.size)
        return held[:, first].T, group

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of these documents, weight by term."""
        lengths = self.ends[docs + 1] - self.ends[docs]
        at = np.repeat(self.ends[docs] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, np.repeat(np.arange(len(docs)), lengths), weight[self.term[at]] * self.share[at])
        return out


def best_of(block: Block, wanted: np.ndarray, weights: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the block, among them all that can be under the k best: masks are taken by the most that their terms can
    score, until k documents score above what is left. least: a score that k documents reach elsewhere. weight: zeros by term, used and
    left as found."""
    rows = np.searchsorted(block.here, wanted)
    there = (rows < len(block.here)) & (block.here[np.minimum(rows, len(block.here) - 1)] == wanted) & (weights > 0)
    rows, wanted, weights = rows[there], wanted[there], weights[there]
    none = np.zeros(0, np.int64)
    if not len(rows):
        return none, none
    masks, group = block.groups(rows)
    most = masks @ (weights * block.best[rows])
    by_mask = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=len(most)))
    order = np.argsort(-most, kind="stable")
    order = order[(most[order] > 0) & (most[order] >= least)]
    counts = np.cumsum(ends[order] - np.concatenate([[0], ends])[order])
    weight[wanted] = weights
    docs, scores, at, step = none, none, 0, FIRST_ROWS
    while at < len(order) and most[order[at]] >= least:
        until = max(at + 1, int(np.searchsorted(counts, (counts[at - 1] if at else 0) + step, side="right")))
        some = np.concatenate([by_mask[ends[g - 1] if g else 0 : ends[g]] for g in order[at:until]])
        docs, scores = np.concatenate([docs, some]), np.concatenate([scores, block.scores(some, weight)])
        at, step = until, 2 * step
        if len(scores) >= k:
            least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            keep = scores >= least
            docs, scores = docs[keep], scores[keep]
    weight[wanted] = 0
    keep = (scores > 0) & (scores >= least)
    return docs[keep], scores[keep]


def _best_rows(posted: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], n_terms: int, total: int, length: int, k: int) -> DataFrame:
    """(item place, doc_id, score): the k best of each block and item, over blocks of Arrow batches."""
    sent = posted.sparkSession.sparkContext.broadcast(items)
    kind = posted.schema["doc_id"].dataType.simpleString()

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(n_terms, np.int64)
        least = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            block = Block(batch, total, length)
            if not len(block.here):
                continue
            place = pc.rank(batch.column(0), sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
            found = ([], [], [])
            for i, (wanted, weights) in enumerate(sent.value):
                docs, scores = best_of(block, wanted, weights, weight, k, int(least[i]))
                first = np.lexsort((place[docs], -scores))[:k]
                if len(first) == k:
                    least[i] = max(least[i], scores[first[-1]])
                for into, x in zip(found, (np.full(len(first), i), docs[first], scores[first]), strict=True):
                    into.append(x)
            item, docs, scores = map(np.concatenate, found)
            arrays = [pa.array(item, pa.int32()), batch.column(0).take(pa.array(docs, pa.int64())), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["item", "doc_id", "score"])

    return posted.mapInArrow(searched, f"item int, doc_id {kind}, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = K, most_terms: int = MOST_TERMS) -> DataFrame:
    """The k best rows of docs (doc_id, text) for each of items (item_id, text): item_id, rank from 1, doc_id, score; equal scores by
    ascending doc_id. Only scores above 0 count.

    A pass over the texts writes each row's postings of the items' terms, from which come the counts that weights need; a pass over the
    postings groups the rows of an Arrow batch by the mask of an item's terms that they hold, by bitmaps, and scores masks by descending
    maximum until no other can reach the k best. No row is dropped before that is proved; k rows per item and task are shuffled.
    Items are sent to all tasks as long as they have at most most_terms terms together; more are searched for in several passes.

    Rows of items with one item_id are one item with the terms of all. Null and empty texts have no terms: such rows aren't found, such
    items find nothing. Repeated rows are ranked each by itself, null doc_ids come last among equal scores, a null item_id is an item.
    Empty tables give no rows, other columns are ignored. Texts are read whole.
    """
    spark = docs.sparkSession
    wanted = materialize(items.select("item_id", F.explode(terms(F.col("text"))).alias("term")).distinct(), "search-terms")
    passes = max(1, -(-wanted.count() // most_terms))
    out = None
    for p in range(passes):
        mine = wanted if passes == 1 else wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p)
        by_item = mine.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).collect()  # at most about most_terms terms
        vocabulary = sorted({t for r in by_item for t in r.terms})
        place = {t: i for i, t in enumerate(vocabulary)}
        posted = materialize(postings(docs, vocabulary), "search-postings")
        total, length = posted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = posted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # one row per term of the items
        weight = np.zeros(len(vocabulary), np.int64)
        for r in held:
            weight[r.term] = math.floor(WEIGHT_UNIT * math.log((2 * total + 2) / (2 * r["count"] + 1)))
        asked = [(np.array(sorted(place[t] for t in r.terms), np.int64), weight[sorted(place[t] for t in r.terms)]) for r in by_item]
        best = _best_rows(posted, asked, len(vocabulary), total, length, k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(by_item)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        some = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = some if out is None else out.unionByName(some)
    return out
