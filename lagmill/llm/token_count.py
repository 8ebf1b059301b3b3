"""Token counts with a whole-token shortcut: pre-tokens proved to be one token are counted as such, only the rest are merged."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 512
#: Counts of merged pre-tokens that a worker remembers; it starts afresh beyond.
MOST_CACHED = 200_000


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = [], 256
    for b in range(256):
        if b in plain:
            table.append(chr(b))
        else:
            table.append(chr(spare))
            spare += 1
    return table


BYTE_CHARS = _byte_alphabet()
#: Fixed value: the public pre-token pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: The same for ASCII texts, which the standard library's engine splits faster.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
_TRANSLATION = dict(enumerate(BYTE_CHARS))


def mapped(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_TRANSLATION)


class TokenCounter:
    """Counts tokens of a byte-level BPE tokenizer file of the tokenizers library (its JSON text)."""

    def __init__(self, spec: str, whole: frozenset[str] | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        added = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.any_pieces, self.ascii_pieces = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall
        self.whole = self.prove(spec) if whole is None else whole
        self.cache: dict[str, int] = {}

    def prove(self, spec: str) -> frozenset[str]:
        """The vocabulary strings that are a pre-token of their own and that merging turns into exactly one token."""
        back = {c: b for b, c in enumerate(BYTE_CHARS)}
        found = set()
        for token in json.loads(spec)["model"]["vocab"]:
            try:
                text = bytes(back[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self.pieces(text) == [text] and len(self.model.tokenize(token)) == 1:
                found.add(text)
        return frozenset(found)

    def pieces(self, text: str) -> list[str]:
        return self.ascii_pieces(text) if text.isascii() else self.any_pieces(text)

    def _plain(self, text: str) -> int:
        pieces = self.pieces(text)
        total, whole, cache = len(pieces), self.whole, self.cache
        for p in pieces:
            if p not in whole:
                n = cache.get(p)
                if n is None:
                    if len(cache) >= MOST_CACHED:
                        cache.clear()
                    n = len(self.model.tokenize(mapped(p)))
                    if len(p) < 64:
                        cache[p] = n
                total += n - 1
        return total

    def count(self, text: str | None) -> int:
        """Tokens of the whole text; strings of special tokens count one each, as the library reads them."""
        if not text:
            return 0
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    The driver reads the tokenizer file at path, proves the whole tokens once and broadcasts both; their size is that of
    the vocabulary. Null and empty texts have 0 bytes and tokens. Repeated rows count alike, null ids are kept, an empty table gives no
    rows, other columns are ignored. Very long texts are read whole.
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((spec, TokenCounter(spec).whole))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(*sent.value)
        for batch in batches:
            n = [counter.count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def default_path(spark: SparkSession | None = None, name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
