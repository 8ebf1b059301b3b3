"""Byte-level BPE against tiktoken, and exact round trips."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lagmill.llm import bpe_codec
from lagmill.llm.bpe_codec import ByteBpe, merges_of, read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    tokens = read_ranks(PATH)
    return ByteBpe(tokens, merges_of(tokens), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(codec.tokens)}, special_tokens={})


def ids_of(codec, text):
    return [i for _, ids in codec.blocks(text) for i in ids.tolist()]


def odd_texts(n=3000, seed=7):
    rnd = random.Random(seed)
    kinds = ("ab c", "' \n\t\u0085 stremdl\x1c\x1f ​　\xa0Aé", "\U0001f600\U0001f468‍́eकि가ก 1²", "aeio-=_ .<|endoftext|>")
    texts = ["".join(rnd.choice(k) for _ in range(rnd.randint(1, 60))) for k in kinds for _ in range(n // 4)]
    return ["", "<|endoftext|>", "x" * 5000, " " * 3000 + "y", "\x00", "﻿a", *texts]


def test_ids_are_the_librarys(codec, library, monkeypatch):
    for text in odd_texts():
        assert ids_of(codec, text) == library.encode_ordinary(text), text
    monkeypatch.setattr(bpe_codec, "BLOCK", 7)  # blocks change nothing
    for text in odd_texts():
        assert ids_of(codec, text) == library.encode_ordinary(text), text


def test_every_character_is_classed_as_in_the_library(codec, library):
    for at in range(0, 0x110000, 0x400):
        text = "".join(f"a{chr(c)} {chr(c)}1" for c in range(at, at + 0x400) if not 0xD800 <= c < 0xE000)
        assert ids_of(codec, text) == library.encode_ordinary(text), hex(at)


def test_offsets_and_split_characters(codec):
    text = "naïve \U0001f9e9\U0001f9e9 कि done"
    (part, ids), = codec.blocks(text)
    starts, ends = codec.offsets(part, ids)
    data = text.encode()
    at = 0
    for i, s, e in zip(ids.tolist(), starts, ends, strict=True):
        token = codec.tokens[i]
        chars = [k for k in range(len(text)) if len(text[:k].encode()) < at + len(token) and len(text[: k + 1].encode()) > at]
        assert (s, e) == (chars[0], chars[-1] + 1)
        at += len(token)
    assert at == len(data) and codec.decode(ids) == data
    texts = codec.texts(ids)
    assert "".join(texts) == text and any(t == "" for t in texts) and "�" not in "".join(texts)
    assert codec.texts(ids[:-1] if codec.tokens[ids[-1]] else ids)[-1] != "�"
    cut = next(k for k, t in enumerate(texts) if t == "")
    assert codec.texts(ids[: cut + 1])[-1] == "�"


def test_operators_over_odd_rows(spark, codec, library):
    texts = [None, "", *odd_texts(40), "word " * 60_000, "é" * 30_000]
    rows = [(None if i == 3 else i, t, "x") for i, t in enumerate(texts)] + [(4, texts[4], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = sorted(((d is None, d or 0), library.encode_ordinary(t or ""), t or "") for d, t, _ in rows)
    encoded = bpe_codec.encode(docs, PATH, offsets=True)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.ids, r.starts, r.ends) for r in encoded.collect())
    assert [(k, i) for k, i, _, _ in got] == [(k, i) for k, i, _ in want]
    for (_, ids, starts, ends), (_, _, text) in zip(got, want, strict=True):
        if ids:
            assert starts[0] == 0 and ends[-1] == len(text) and all(a <= b for a, b in zip(starts, starts[1:], strict=False))
            plain = [k for k in range(len(ids)) if codec.tokens[ids[k]].isascii()]
            assert all(text[starts[k] : ends[k]].encode() == codec.tokens[ids[k]] for k in plain)
    back = {r.doc_id: r for r in bpe_codec.decode(encoded, PATH).collect()}
    assert all(bytes(back[d].bytes) == (t or "").encode() and "".join(back[d].texts) == (t or "") for d, t, _ in rows)
    trip = bpe_codec.round_trip(docs, PATH).collect()
    assert len(trip) == len(rows) and all(r.restored for r in trip)
    found = sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in trip)
    assert found == [(k, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for k, i, t in want]
    none = docs.limit(0)
    assert bpe_codec.encode(none, PATH).count() == bpe_codec.round_trip(none, PATH).count() == 0
    lost = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [(bytes(r.bytes), r.texts) for r in bpe_codec.decode(lost, PATH).collect()] == [(b"", []), (b"", [])]


def test_files_that_are_no_ranks_are_refused(tmp_path):
    bad = tmp_path / "ranks"
    bad.write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        read_ranks(str(bad))
    with pytest.raises(ValueError):
        merges_of([bytes([b]) for b in range(256)] + [b"abc"])
