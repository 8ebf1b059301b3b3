"""Ranked lexical search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from lagmill.llm import lexical_search
from lagmill.llm.lexical_search import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    total = sum(1 for _, c in counts if c)
    length = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        rows = []
        for d, c in counts:
            n = sum(c.values())
            m = 10 + (90 * n * total) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                rows.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def tables(seed, n_docs, n_items, vocabulary=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "é", "Ünï", "don't", "日本"]
    odds = [1 / (i + 1) for i in range(len(words))]

    def text(n):
        return " ".join(w.upper() if rnd.random() < 0.1 else w for w in rnd.choices(words, odds, k=n))

    docs = [(i, text(rnd.choice((1, 5, 40, 200)))) for i in range(n_docs)] + [(n_docs, None), (n_docs + 1, ""), (n_docs + 2, "-- \n"), (None, text(30)), (None, "w1 w2")]
    docs += [(500 + i, docs[3][1]) for i in range(30)] + [docs[5]] * 3  # ties and repeated rows
    items = [(str(i), text(rnd.choice((1, 3, 30)))) for i in range(n_items)] + [("n", None), ("e", " "), ("x", "nowhere"), ("0", "w9 w30"), (None, "w4"), ("long", " ".join(words))]
    return docs, items


@pytest.mark.parametrize("rows", [5, 10_000])
def test_ranks_match_brute_force(spark, monkeypatch, rows):
    docs, items = tables(3, 150, 12)
    monkeypatch.setattr(lexical_search, "FIRST_ROWS", 2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string")
        i = spark.createDataFrame([(*r, 1) for r in items], "item_id string, text string, rank int")
        assert sorted(map(tuple, search(d, i).collect()), key=str) == brute(docs, items)
        assert sorted(map(tuple, search(d, i, k=3, most_terms=40).collect()), key=str) == brute(docs, items, 3)  # several passes
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_more_than_one_word_of_mask_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 50)  # texts of many blocks
    docs, items = tables(4, 60, 2, vocabulary=300)
    docs.append((900, "w1 w250 " * 20_000))
    items.append(("many", " ".join(f"w{i}" for i in range(300))))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert sorted(map(tuple, search(d, i).collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = tables(5, 5, 2)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert search(d.limit(0), i).count() == search(d, i.limit(0)).count() == search(d.filter("text = ''"), i).count() == 0
