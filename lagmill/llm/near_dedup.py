"""MinHash near-duplicates: fast similarity sketches, banding, exact verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagmill.llm.common import components, discard, materialize, star_labels

SHINGLE = 5
COORDS, ROWS = 128, 4
#: A pair at similarity 0.75 shares none of the 32 bands with probability (1 - 0.75**4)**32 = 5e-6.
BANDS = COORDS // ROWS
#: Sketch agreement below which a pair is not verified: 0.75 less 4.5 standard deviations of the estimate from 128 coordinates
#: (a pair at 0.75 falls below with probability 3e-6, like the banding).
LEAST_AGREED = int(COORDS * (0.75 - 4.5 * (0.75 * 0.25 / COORDS) ** 0.5))
#: Members of a block and shingles of all of them, about: what one comparing task holds at a time, twice.
BLOCK, BLOCK_SHINGLES = 2048, 4_000_000
#: Ids that are broadcast, at most: 8 bytes each.
MOST_SENT = 1_000_000
#: Documents per task of the smaller tables, about: these are written in as many tasks as the documents ask for.
TASK_ROWS = 20_000

_M1, _M2, _ROLL = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SHIFT = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; of fewer words, one hash of them all; of none, nothing."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - k + 1
    roll = h[:n].copy()
    for i in range(1, k):
        roll = _mix(roll * _ROLL + h[i : i + n])
    return np.unique(roll)


def _seeds(t: int) -> np.ndarray:
    return _mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * _ROLL)


_SEEDS = _seeds(COORDS)


def sketch(x: np.ndarray, t: int = COORDS) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: in each of the first t rounds every element falls into one hashed bin, in
    the next t rounds all into bin (round - t); a bin keeps its smallest (round, hash). All bins are full after 2t rounds, mostly
    after few, and later rounds can't change a full bin, so it stops there. Returns t 32-bit values; two sets agree
    in a coordinate with probability equal to their Jaccard similarity."""
    seeds = _SEEDS if t == COORDS else _seeds(t)
    out = np.full(t, _EMPTY, np.uint64)
    start, step = 0, max(1, 4096 // len(x))
    while start < 2 * t and (out == _EMPTY).any():
        rounds = np.arange(start, min(2 * t, start + step), dtype=np.uint64)[:, None]
        g = _mix(x[None, :] ^ seeds[start : start + len(rounds), None])
        bins = np.where(rounds < np.uint64(t), ((g >> _SHIFT) * np.uint64(t)) >> _SHIFT, rounds - np.uint64(t))
        np.minimum.at(out, bins.astype(np.intp).ravel(), ((rounds << _SHIFT) | (g & _LOW)).ravel())
        start += step
    return (_mix(out) & _LOW).astype(np.uint32)


def band_keys(s: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys of (documents, COORDS) sketches."""
    parts = s.reshape(len(s), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = _mix(key * _ROLL + parts[:, :, i])
    return key.view(np.int64)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, sketches = [], [], []
        for text in batch.column(1):
            x = shingle_set(text.as_py())
            sizes.append(len(x))
            keys.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
            sketches.append(sketch(x).tobytes() if len(x) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())],
            names=["doc_id", "n_shingles", "set_key", "sketch"],
        )


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDS)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(s).ravel()), pa.array(ids, pa.int64())], names=["key", "id"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "full"])


def _agree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose sketches agree often enough."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, COORDS) for i in (2, 3))
            keep = pa.array((a == b).sum(axis=1) >= LEAST_AGREED)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 75 * union of two sorted sets."""
    if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= 75 * (len(both) - shared)


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs that are similar on the full sets."""
    for batch in batches:
        sets = zip(batch.column(2), batch.column(3), strict=True)
        keep = pa.array([_similar(*(np.frombuffer(v.as_py(), np.uint64) for v in xy)) for xy in sets], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


class _Forest:
    """Union-find over the components met in one block."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[x] = y
        return x != y


def _block_candidates(pdf):
    """Positions (p, q), agreement descending, of a block's pairs of different components whose sketches agree often enough; p a left row, q a
    right one. A pair that shares several buckets is taken in the one with the smallest key; one that could be met from either side, once."""
    s = np.frombuffer(b"".join(pdf["sketch"]), np.uint32).reshape(-1, COORDS)
    bands, ids, comp = band_keys(s), pdf["id"].to_numpy(), pdf["component"].to_numpy()
    key, main = pdf["key"].iat[0], pdf["main"].iat[0]
    side = pdf["side"].to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found = [np.empty((0, 3), np.int64)]
    for p in left:
        q = right[(comp[right] != comp[p]) & ((comp[right] == main) | (ids[right] > ids[p]))]
        n = (s[q] == s[p]).sum(axis=1)
        q, n = q[n >= LEAST_AGREED], n[n >= LEAST_AGREED]
        if len(q):
            first = np.where(bands[q] == bands[p], bands[q], np.iinfo(np.int64).max).min(axis=1) == key
            found.append(np.stack([np.full(first.sum(), p), q[first], n[first]], axis=1))
    found = np.concatenate(found)
    return found[np.argsort(-found[:, 2], kind="stable"), :2]


def _block_forest(pdf):
    """Of a block's candidates those, best first, that would join its components to a forest: fewer than it has members."""
    import pandas as pd

    ids, comp, forest = pdf["id"].to_numpy(), pdf["component"].to_numpy(), _Forest()
    pairs = [(ids[p], ids[q]) for p, q in _block_candidates(pdf) if forest.join(comp[p], comp[q])]
    return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")


def _block_open(pdf):
    """The members of a block that have a candidate."""
    return pdf.iloc[np.unique(_block_candidates(pdf))]


def _block_links(pdf):
    """The candidates of a block that hold on the full sets, without those that join nothing new."""
    import pandas as pd

    ids, comp, forest, pairs = pdf["id"].to_numpy(), pdf["component"].to_numpy(), _Forest(), []
    sets = [np.frombuffer(x, np.uint64) for x in pdf["full"]]
    for p, q in _block_candidates(pdf):
        if forest.root(comp[p]) != forest.root(comp[q]) and _similar(sets[p], sets[q]):
            forest.join(comp[p], comp[q])
            pairs.append((ids[p], ids[q]))
    return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")


def _full_sets(ids: DataFrame, docs: DataFrame, parts: int) -> DataFrame:
    """id, full: the shingle sets of these documents (a written table of ids), recomputed from their texts. Up to MOST_SENT ids go to
    the texts, beyond that the texts are shuffled by id."""
    side = ids.toDF("doc_id")
    side = F.broadcast(side) if ids.count() <= MOST_SENT else side
    texts = docs.join(side, "doc_id", "left_semi").select("doc_id", F.col("text").cast("binary"))
    sets = materialize(texts.mapInArrow(_set_batches, "id bigint, full binary"), "nd-sets", parts)
    if sets.count() == ids.count():
        return sets
    once = materialize(sets.distinct(), "nd-sets", parts)  # repeated rows
    discard(sets)
    return once


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, parts: int) -> DataFrame:
    """The pairs (a, b) that the sketches don't rule out and that hold on the full sets."""
    known = reps.select("id", "sketch")
    sketched = pairs.join(known.toDF("a", "sketch_a"), "a").join(known.toDF("b", "sketch_b"), "b").select("a", "b", "sketch_a", "sketch_b")
    agreed = materialize(sketched.mapInArrow(_agree_batches, "a bigint, b bigint"), "nd-agreed", parts)
    ids = materialize(agreed.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "nd-ids", parts)
    sets = _full_sets(ids, docs, parts)
    full = agreed.join(sets.toDF("a", "full_a"), "a").join(sets.toDF("b", "full_b"), "b").select("a", "b", "full_a", "full_b")
    out = materialize(full.mapInArrow(_verify_batches, "a bigint, b bigint").distinct(), "nd-links", parts)
    for done in (agreed, ids, sets):
        discard(done)
    return out


def _open_blocks(members: DataFrame, part: DataFrame, reps: DataFrame, parts: int) -> DataFrame:
    """Members of the buckets that still hold several components, dealt to blocks (key, i, j): left rows (side 0) are the members outside
    the bucket's main (largest) component, right rows (side 1) all members, each cut into pieces of about BLOCK members or BLOCK_SHINGLES
    shingles, whichever is less. So a large component with a few strangers is sent about once."""
    sized = members.join(part, "id", "left").join(reps.select("id", "n_shingles"), "id")
    labelled = materialize(sized.select("key", "id", "n_shingles", F.coalesce("component", "id").alias("component")), "nd-labelled", parts)
    per = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("w"))
    several = per.groupBy("key").agg(
        F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "w", "component")).alias("top"), F.sum("c").alias("n"), F.sum("w").alias("weight")
    ).where("k > 1")
    pieces = lambda n, w: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    several = several.select(
        "key", F.col("top.component").alias("main"), pieces(F.col("n") - F.col("top.c"), F.col("weight") - F.col("top.w")).alias("lefts"),
        pieces(F.col("n"), F.col("weight")).alias("rights"),
    )
    several = materialize(several, "nd-several", parts)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda n, at: F.transform(F.sequence(F.lit(0), F.col(n) - 1), at)
    left = spread("rights", lambda j: F.struct(own("lefts").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    right = spread("lefts", lambda i: F.struct(i.alias("i"), own("rights").alias("j"), F.lit(1).alias("side")))
    places = F.when(F.col("component") != F.col("main"), F.concat(left, right)).otherwise(right)
    dealt = labelled.join(several, "key").select("key", "id", "component", "main", F.explode(places).alias("p"))
    return dealt.select("key", "id", "component", "main", "p.*").join(reps.select("id", "sketch"), "id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Near-duplicate components of documents (doc_id, text): one row per input row with doc_id, n_shingles (size of its set
    of five-word shingles), component_id (smallest doc_id reachable over links of similarity 0.75 or more) and kept.

    Equal sets become one class first. Class representatives are sketched and banded. In each bucket every member is compared
    with the bucket's smallest id, never all pairs. Buckets that still hold several components are compared in blocks of bounded
    size: first a forest of the best-agreeing pairs between components is verified, then, where components remain apart, all their pairs
    that the sketch doesn't rule out, within the block's task, which returns the links that join something new. So pairs written stay
    in proportion to members, every link rests on full sets, and none that banding found is lost. Nothing is capped.

    Null and empty texts have an empty set, link with nothing and are kept. Rows with a null doc_id link with nothing: their
    component_id is null, kept is true. Repeated rows share their set, hence their component. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    base = materialize(
        docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(
            _sketch_batches, "doc_id bigint, n_shingles bigint, set_key binary, sketch binary"
        ),
        "nd-base",
    )
    parts = 8 + base.count() // TASK_ROWS
    known = base.where("doc_id is not null and set_key is not null")
    counts = known.groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    classes = materialize(counts.where("n > 1").drop("n"), "nd-classes", parts)
    rows = base.drop("sketch").join(classes, "set_key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("set_key").isNotNull(), F.coalesce("first_id", "doc_id")).alias("id")
    )
    # One row per id and set: a repeated row's set is in a class.
    shape = (F.col("doc_id").alias("id"), "sketch", "n_shingles")
    classed = known.join(classes, "set_key").where("first_id = doc_id").dropDuplicates(["doc_id", "set_key"])
    reps = known.join(classes, "set_key", "left_anti").select(*shape).unionByName(classed.select(*shape))
    reps = materialize(reps, "nd-reps", parts)
    bands = materialize(reps.select("id", "sketch").mapInArrow(_band_batches, "key bigint, id bigint"), "nd-bands")
    # Buckets with the same members are one: most groups of copies meet in many bands. An id with several sets may occur more than once in a
    # bucket, where it cancels in the exclusive or, but not in the sums.
    h = F.xxhash64("id")
    sums = (F.sum(F.shiftright(h, 31)), F.sum(F.shiftright(F.xxhash64("id", F.lit(1)), 31)))
    buckets = (
        bands.groupBy("key")
        .agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n"), F.struct(F.bit_xor(h), *sums).alias("members"))
        .where("n > 1")
        .groupBy("leader", "n", "members")
        .agg(F.min("key").alias("key"))
    )
    buckets = materialize(buckets.drop("members"), "nd-buckets", parts)
    members = materialize(bands.join(buckets, "key"), "nd-members", parts)
    discard(bands)
    stars = members.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = _verified(stars, reps, docs, parts)
    near = materialize(star_labels(links, "a", "b"), "nd-near", parts)
    larger = members.where("n > 2").select("key", "id")

    forest = _open_blocks(larger, near, reps, parts).groupBy("key", "i", "j").applyInPandas(_block_forest, "a bigint, b bigint").distinct()
    links = materialize(links.unionByName(_verified(forest, reps, docs, parts)), "nd-links", parts)
    part = materialize(components(links, "a", "b"), "nd-part", parts)

    shape = "key bigint, id bigint, component bigint, main bigint, i int, j int, side int, sketch binary"
    left = _open_blocks(larger, part, reps, parts).select(*(c.split()[0] for c in shape.split(", ")))
    left = materialize(left.groupBy("key", "i", "j").applyInPandas(_block_open, shape), "nd-open", parts)
    final = part
    if left.limit(1).count():
        sets = _full_sets(materialize(left.select("id").distinct(), "nd-ids", parts), docs, parts)
        last = left.join(sets, "id").groupBy("key", "i", "j").applyInPandas(_block_links, "a bigint, b bigint").distinct()
        last = materialize(last, "nd-last", parts)
        if last.limit(1).count():
            final = components(links.unionByName(last), "a", "b")
    return (
        rows.join(final, "id", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
