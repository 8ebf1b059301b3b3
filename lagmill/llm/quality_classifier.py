"""Quality classifier: histogram gradient-boosted trees over document statistics, traversed as flat arrays."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: At most so many labelled rows train the model, those with the smallest hashes of their ids.
MOST_LABELLED = 20_000

FEATURES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "upper", "digit", "space", "newline", "punctuation", "symbol", "bang",
    "pipe", "high_bytes", "byte_entropy", "distinct_words", "top_word", "same_as_last", "distinct_bigrams", "dup_lines",
    "mean_line", "words_per_stop", "short_words", "upper_words", "odd_ends", "longest_word",
)


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256)
    m[list(chars)] = 1
    return m


_CLASSES = np.stack([
    _mask(bytes(range(65, 91))), _mask(bytes(range(48, 58))), _mask(b" \t\n\r\x0b\x0c"), _mask(b"\n"), _mask(b".,;:!?'\"()-"),
    _mask(b"#*$%&<>@^~=+_\\/{}[]"), _mask(b"!"), _mask(b"|"), _mask(bytes(range(128, 256))),
])
_SHARES = _CLASSES.T.copy()


def document_statistics(text: str | None) -> np.ndarray:
    """The FEATURES of one whole text; an empty or null text gives zeros."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return np.zeros(len(FEATURES), np.float32)
    n, w = len(data), len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, w)
    lines = [x for x in data.split(b"\n") if x.strip()]
    out = [np.log1p(n), np.log1p(w), lengths.mean(), lengths.std()]
    out += list(counts @ _SHARES / n)
    out += [
        -(p * np.log2(p)).sum(),
        len(set(words)) / w,
        max(Counter(words).values()) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w,
        len(set(zip(words, words[1:], strict=False))) / max(1, w - 1),
        1 - len(set(lines)) / len(lines),
        np.log1p(w / len(lines)),
        np.log1p(w / (1 + counts[46])),
        (lengths <= 3).mean(),
        sum(map(bytes.isupper, words)) / w,
        sum(not x[-1:].isalnum() and x[-1] < 128 and x[-1] not in b".,;:" for x in words) / w,
        np.log1p(lengths.max()),
    ]
    return np.array(out, np.float32)


@dataclass
class TreeModel:
    """Trees as complete binary arrays: feature and threshold of every inner node, value of every leaf, (trees, nodes)."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: all rows walk all trees at once, one level a step."""
        at = np.zeros((len(x), len(self.feature)), np.int64)
        trees, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        margin = self.base + self.value[trees, at - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 1.0) -> TreeModel:
    """Boosted trees on the logistic loss. Features are cut once at quantiles; each level adds up gradients and curvatures per
    node, feature and bin, and takes the best cut of every node. A node without a gain keeps all rows to the left.
    `least` is the curvature a child needs. Without rows, or with one class only, the model is its base rate."""
    inner, f = 2**depth - 1, x.shape[1]
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model = TreeModel(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1)), float(np.log(mean / (1 - mean))), depth)
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins).astype(np.float32)) for j in range(f)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    offsets = np.arange(f)[None, :] * bins
    margin = np.full(len(y), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (f * bins) + offsets + binned).ravel()
            gs, hs = (np.bincount(cell, np.repeat(v, f), width * f * bins).reshape(width, f, bins).cumsum(axis=2) for v in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < least) | (ht - hs < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in np.flatnonzero(gain.reshape(width, -1).max(axis=1) > 1e-9):
                j, b = divmod(int(best[k]), bins)
                if b < len(cuts[j]):
                    model.feature[t, first + k], model.threshold[t, first + k] = j, cuts[j][b]
            right = x[np.arange(len(y)), model.feature[t, node]] > model.threshold[t, node]
            node = 2 * node + 1 + right
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        model.value[t] = value
        margin += value[leaf]
    return model


def held_out(doc_id):
    """True where crc32 of the id as text, modulo 3, is 1: rows that never train."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> TreeModel:
    """Fit on the statistics of at most `most` labelled documents that aren't held out. Several labels of an id count as their
    minimum, and of several texts of an id the one of least hash trains; null ids and labels train nothing. The sample's ids are bounded by
    `most`, so they are broadcast, and so are the rows that reach the driver."""
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["_quality"], "x": [document_statistics(t) for t in pdf["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(one, F.min(F.col("_quality").cast("double")).alias("_quality"))
    rows = rows.mapInPandas(measured, f"doc_id {kind}, y double, x array<float>").toPandas().sort_values("doc_id", kind="stable")
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.empty((0, len(FEATURES)), np.float32)
    return fit_trees(x, rows["y"].to_numpy(np.float64))


def score_column(model: TreeModel, text):
    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.scores(np.stack([document_statistics(t) for t in texts])))

    return score(text)


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score in [0, 1] (higher: good quality likelier) and predicted (1 from 0.5 on).

    Only the text enters a score. Null and empty texts score as zero statistics. A null doc_id isn't held out and
    trains nothing. Repeated rows score alike. Without usable labels every score is 0.5; an empty docs table gives no rows.
    Other columns are ignored.
    """
    model = train(docs, labels, most)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def crc_is_held_out(doc_id: int) -> bool:
    """The same rule for one id, for checks outside Spark."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
