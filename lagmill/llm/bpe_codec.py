"""Byte-level BPE encoding and decoding over Arrow batches: the tokenizers library merges, a byte table gives characters and offsets."""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagmill.llm.token_count import BYTE_CHARS, mapped

#: Characters of a text that are encoded at a time; a block ends before a blank, where no pre-token can cross.
BLOCK = 1 << 20
#: Tokens in one Arrow batch that encode() gives out, unless one text alone has more.
MOST_TOKENS = 1 << 22
#: Pre-tokens whose ids a worker remembers; it starts afresh beyond. Longer pre-tokens than this many characters aren't remembered.
MOST_CACHED, LONGEST_CACHED = 200_000, 64
_CUT = re.compile(r"(?<=[!-~])(?= )")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a file of base64 token and rank a line, by rank. Ranks must be 0, 1, ... and every byte must be a token."""
    with open(path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    tokens = [t for _, t in ranked]
    if [r for r, _ in ranked] != list(range(len(tokens))) or len(set(tokens)) < len(tokens) or not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError(f"{path}: ranks must count from 0 over distinct tokens, all 256 bytes among them")
    return tokens


def merges_of(tokens: list[bytes]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each longer token, by rank: what merging its bytes by lower ranks leaves."""
    rank = {t: r for r, t in enumerate(tokens)}
    pairs = []
    for r, token in enumerate(tokens):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            k, i = min((rank.get(parts[i] + parts[i + 1], r), i) for i in range(len(parts) - 1))
            if k >= r:
                raise ValueError(f"token {r} is no merge of tokens of lower rank")
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            pairs.append((parts[0], parts[1]))
    return pairs


class ByteBpe:
    """Encodes and decodes by a table of tokens; merging is the tokenizers library's, each pre-token by itself."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[bytes, bytes]], pattern: str) -> None:
        from tokenizers import models

        chars = str.maketrans(dict(enumerate(BYTE_CHARS)))
        shown = [t.decode("latin-1").translate(chars) for t in tokens]
        pairs = [(a.decode("latin-1").translate(chars), b.decode("latin-1").translate(chars)) for a, b in merges]
        self.model = models.BPE(vocab={t: i for i, t in enumerate(shown)}, merges=pairs)
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.pieces = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def _merged(self, piece: str) -> bytes:
        """ids of one pre-token, little-endian."""
        ids = np.array([t.id for t in self.model.tokenize(mapped(piece))], "<u4").tobytes()
        if len(piece) <= LONGEST_CACHED:
            if len(self.cache) >= MOST_CACHED:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def blocks(self, text: str) -> Iterator[tuple[str, np.ndarray]]:
        """(part of the text, its ids) in order; parts join to the text, ids to its encoding."""
        at, known = 0, self.cache.get
        while at < len(text):
            cut = _CUT.search(text, at + BLOCK) if len(text) - at > BLOCK else None
            part = text[at : cut.start()] if cut else text[at:]
            at += len(part)
            yield part, np.frombuffer(b"".join([known(p) or self._merged(p) for p in self.pieces(part)]), "<u4")

    def offsets(self, part: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token of a part. Tokens that share a split character all span it."""
        ends = np.cumsum(self.lengths[ids])
        lead = (np.frombuffer(part.encode(), np.uint8) & 0xC0) != 0x80
        char = np.cumsum(lead)  # 1 + the character of each byte
        return char[ends - self.lengths[ids]] - 1, char[ends - 1]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def texts(self, ids: np.ndarray) -> list[str]:
        """The text that each token adds: a character split over tokens comes with the token that completes it; bytes that are no UTF-8
        become U+FFFD, those left over at the end come with the last token."""
        decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
        last = len(ids) - 1
        return [decoder.decode(self.tokens[i], k == last) for k, i in enumerate(ids.tolist())]


def _with_codec(docs: DataFrame, path: str, pattern: str | None, run: Callable, schema: str) -> DataFrame:
    """mapInArrow of run(codec, batches), the codec built once a worker from the broadcast table of the file at path. Its size is the vocabulary's."""
    tokens = read_ranks(path)
    sent = docs.sparkSession.sparkContext.broadcast((tokens, merges_of(tokens), pattern or default_pattern()))

    def mapped_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(ByteBpe(*sent.value), batches)

    return docs.mapInArrow(mapped_batches, schema)


def _lists(doc_ids: list, rows: list[list[np.ndarray]], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    """One row per id with an int list per name; rows[name][row]."""
    arrays = [pa.array(doc_ids, kind)]
    for column in rows:
        ends = np.cumsum([0] + [len(x) for x in column])
        flat = np.concatenate(column).astype(np.int32) if column else np.zeros(0, np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *names])


def encode(docs: DataFrame, path: str, pattern: str | None = None, offsets: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id and ids, an array of the text's tokens; with offsets also starts and ends, the characters
    (code points, end exclusive) each token spans. Tokens of one split character all span it.

    path: a file of base64 tokens and ranks; pattern: what a pre-token is (public_tokenizers.PATTERN if None). The driver derives the
    merges and broadcasts both; their size is that of the vocabulary. Texts are read whole, in blocks; only the ids of one row must fit
    into a task. Null and empty texts have no tokens, strings of special tokens are plain text. Repeated rows encode alike, null ids are
    kept, an empty table gives no rows, other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["ids", "starts", "ends"] if offsets else ["ids"]

    def encoded(codec: ByteBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, columns, held = [], [[] for _ in names], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, at = [[np.zeros(0, np.int64)] for _ in names], 0
                for part, some in codec.blocks(text.as_py()):
                    for into, x in zip(found, (some, *(o + at for o in (codec.offsets(part, some) if offsets else ()))), strict=True):
                        into.append(x)
                    at += len(part)
                ids.append(doc_id)
                for into, x in zip(columns, found, strict=True):
                    into.append(np.concatenate(x))
                held += len(columns[0][-1])
                if held > MOST_TOKENS:
                    yield _lists(ids, columns, batch.schema.field(0).type, names)
                    ids, columns, held = [], [[] for _ in names], 0
            yield _lists(ids, columns, batch.schema.field(0).type, names)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _with_codec(rows, path, pattern, encoded, f"doc_id {kind}, " + ", ".join(f"{n} array<int>" for n in names))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Per row of rows (doc_id, ids): doc_id, bytes (what the tokens stand for), and texts, the text that each token adds: a character
    that is split over tokens comes whole with the token that completes it, bytes that are no UTF-8 become U+FFFD.

    Null and empty ids give no bytes and no texts. An id that isn't in the file at path fails the job. Repeated rows decode alike, null
    doc_ids are kept, an empty table gives no rows, other columns are ignored.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def decoded(codec: ByteBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [np.array(x.as_py(), np.int64) for x in batch.column(1)]
            arrays = [batch.column(0), pa.array(map(codec.decode, some), pa.binary()), pa.array(map(codec.texts, some), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "bytes", "texts"])

    full = rows.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return _with_codec(full, path, None, decoded, f"doc_id {kind}, bytes binary, texts array<string>")


def round_trip(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256 (of the
    bytes that the ids decode to) and restored (those bytes are the text's). encode() and decode() of a row in one pass, block by block:
    a very long text is never held as ids.

    Null and empty texts have no tokens and the digests of nothing. Repeated rows count alike, null ids are kept, an empty table gives no
    rows, other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digests(codec: ByteBpe, text: str) -> tuple[int, str, str, bool]:
        n, ids_sum, bytes_sum, same = 0, hashlib.sha256(), hashlib.sha256(), True
        for part, ids in codec.blocks(text):
            data = codec.decode(ids)
            n += len(ids)
            ids_sum.update(ids)
            bytes_sum.update(data)
            same &= data == part.encode()
        return n, ids_sum.hexdigest(), bytes_sum.hexdigest(), same

    def gone_round(codec: ByteBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(digests(codec, t.as_py()) for t in batch.column(1)), strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            arrays = [batch.column(0), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "restored"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _with_codec(rows, path, pattern, gone_round, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, restored boolean")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN
