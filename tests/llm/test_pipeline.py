"""The pipeline's stages, each against a brute-force version on the smallest documents table, and run() as their chain."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import __spark_entry__
import corpus_pipeline
from lagmill.llm import mixing, quality_classifier, queries

SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs.collect(), spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
        got = Counter(r.doc_id for r in kept[name])
        if name == "quality_classifier":
            good = {r.doc_id for r in quality_classifier.classify(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect() if r.predicted}
            assert set(got) == good and len(good) > 150
        elif name == "near_dedup":
            sets = {r.doc_id: shingles(r.text) for r in before}
            up = {i: i for i in sets}

            def root(x):
                while up[x] != x:
                    x = up[x]
                return x

            for i in sets:
                for j in sets:
                    if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                        a, b = sorted((root(i), root(j)))
                        up[b] = a
            assert set(got) == {i for i in sets if root(i) == i} and len(got) < len(before)
        elif name == "decontamination":
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
            windows = {tuple(w[i : i + 10]) for w in map(words, items) for i in range(max(1, len(w) - 9))}
            assert all(len(w) == 10 for w in windows)
            clean = {r.doc_id for r in before if not windows & {tuple(words(r.text)[i : i + 10]) for i in range(len(words(r.text)) - 9)}}
            assert set(got) == clean
        elif name == "mixing":
            plan = {r.doc_id: r.copies for r in mixing.mix_plan(spark.createDataFrame(before)).collect()}
            assert got == Counter({k: v for k, v in plan.items() if v})
            texts = {r.doc_id: r.text for r in before}
            assert all(r.text == texts[r.doc_id] for r in kept[name])
        else:
            assert got == Counter(r.doc_id for r in before)
            for r in kept[name]:
                b, j, chain = 0, 0, str(r.doc_id)
                while j < 40:
                    b, chain = j, hashlib.md5(chain.encode()).hexdigest()
                    j = int((b + 1) * (2.0**31 / ((int(chain[:8], 16) >> 1) + 1)))
                assert r.shard == b
            assert sorted((r.shard, r.slot) for r in kept[name]) == [(s, i) for s, n in sorted(Counter(r.shard for r in kept[name]).items()) for i in range(n)]
    ran = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, ran)) == sorted(map(str, kept["sharding"]))


def test_registration():
    names = list(__spark_entry__.queries())
    assert [n for n in names if re.match(r"op\d+_", n)] == list(queries.QUERIES) and len(queries.QUERIES) == 10 and "pipeline" in names


def test_stages_on_odd_and_empty_tables(spark):
    """Nulls in every column, empty and repeated rows, a very long text, clashing extra columns, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long_text = " ".join(f"word{i * i % 9973}" for i in range(60_000))
    rows = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (None, "one two", "en", None, 7),
        (4, long_text, "de", "b", len(long_text)), (5, long_text + " end", "de", "b", None), (None, None, None, None, None),
    ]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema).selectExpr("*", "1 as size", "2 as id", "3 as copies", "4 as kept", "5 as contaminated", "6 as shard", "7 as key")
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            got = out.collect()
            if k < 4:
                assert out.columns == list(corpus_pipeline.COLUMNS)
            if not data:
                assert got == [], name
            elif name == "near_dedup":
                assert sorted(r.doc_id or 0 for r in got) == [0, 0, 1, 2, 3, 4]  # repeated rows are one document, rows without an id stay
            elif name == "decontamination":
                assert len(got) == len(rows)
            elif name == "sharding":
                assert sorted(r.doc_id or 0 for r in got) == [0, 0, 1, 2, 3, 3, 4, 5]


def test_rows_that_share_an_id_are_told_apart(spark):
    """Of rows with one doc_id only those fall that are copies or contaminated themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) > 12").first().text
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    near = text("a") + " end"
    rows = [(i, t, "en", "s", 1) for i, t in (
        (3, text("a")), (7, text("a")), (7, text("b")), (9, text("c")), (8, near), (8, text("d")), (8, text("d")), (5, item), (5, text("e")), (None, item), (None, text("f")))]
    docs = spark.createDataFrame(rows, schema)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    groups = {text("a"): 0, near: 0}
    kept = Counter(t if t not in groups else "group" for (_, t), n in got.items() for _ in range(n))
    assert kept == Counter(["group", text("b"), text("c"), text("d"), item, item, text("e"), text("f")])
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, SF).collect())
    assert got == Counter((i, t) for i, t, *_ in rows if t != item)
