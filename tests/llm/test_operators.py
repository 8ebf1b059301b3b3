"""Training-data operators against brute force, exact round trips and held-out accuracy; edge cases of each."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import itertools
import random
import re
import time
import urllib.parse
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lagmill.llm import decontaminate, license_scan, mixing, near_dedup, quality_classifier, quality_rules, secret_scan, sharding, token_count, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty, short and repeated texts, repeated rows.
ODD = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (None, "one two", "en", None, 7),
    (4, " \t\n", "de", "b", 3), (5, "A b C d E f", "de", "b", 11), (6, "a B c D e F", "de", "b", 11), (None, None, None, None, None),
]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # names that the operators use inside
        df = df.selectExpr("*", "1 as size", "2 as id", "3 as key", "4 as copies", "5 as _row", "6 as a", "7 as w", "8 as text_crc32", "9 as grp")
    return df


def words_of(text, pattern=r"[^\x20\x09-\x0D]+"):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(pattern, lowered)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_odd_rows_and_empty_tables(spark):
    docs, empty = frame(spark, ODD), frame(spark, [])
    items = spark.createDataFrame([(1, "one two"), (2, None), (None, "x")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = token_count.default_path()
    runs = {
        "classify": lambda d: quality_classifier.classify(d, labels), "licenses": license_scan.license_matches, "mix": mixing.mix_plan,
        "mixed": mixing.mix, "near": near_dedup.near_duplicates, "secrets": secret_scan.secret_digests, "decon": lambda d: decontaminate.contamination(d, items),
        "shard": sharding.shard, "rules": quality_rules.quality_rules, "tokens": lambda d: token_count.token_counts(d, path),
    }
    got = {k: f(docs).collect() for k, f in runs.items()}
    for k, f in runs.items():
        assert f(empty).collect() == [], k
        if k not in ("licenses", "mixed"):
            assert len(got[k]) == len(ODD), k
    assert {r.score for r in got["classify"]} == {0.5}
    by_id = {r.doc_id: r for r in got["near"] if r.doc_id}
    assert by_id[1].n_shingles == 0 and by_id[1].kept
    assert by_id[3].component_id == 3 and by_id[6].component_id == 5 and not by_id[6].kept
    assert all(r.component_id is None and r.kept for r in got["near"] if r.doc_id is None)
    hit = {r.doc_id: r.n_hit for r in got["decon"] if r.doc_id}
    assert hit == {1: 0, 2: 0, 3: 2, 4: 0, 5: 0, 6: 0}
    assert sorted(r.slot for r in got["shard"] if r.shard == got["shard"][0].shard) == list(range(sum(r.shard == got["shard"][0].shard for r in got["shard"])))
    assert {r.n_words for r in got["rules"]} == {0, 2, 6} and all(r.base_failed and not r.kept for r in got["rules"])


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(25):  # chains of near copies around the threshold
        words = prose(rng, 80).split()
        for _ in range(rng.randrange(1, 7)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    shared = prose(rng, 40)
    texts += [f"{shared} {prose(rng, 45)}" for _ in range(40)] + ["", "a b", "A  b", "word " * 300]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    sets = {}
    for i, t, *_ in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
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
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """One group larger than a block, some of whose members are linked only through others."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(1)
    base = prose(rng, 120, 10**6).split()
    rows = []
    for i in range(60):
        words = list(base)
        for k in range(i % 12):
            words[(k * 9 + i) % 120] = f"y{i}-{k}"
        rows.append((i, " ".join(words), "en", "s", 1))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t, *_ in rows}
    seen, stack = {0}, [0]
    while stack:
        i = stack.pop()
        for j in sets:
            if j not in seen and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                seen.add(j)
                stack.append(j)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert {i for i, c in got.items() if c == 0} == seen


def test_repeated_rows_change_no_component(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for g in range(30):  # one text and several, each hardly similar enough to it
        base = prose(rng, 100, 10**6).split()
        rows.append((100 * g, " ".join(base), "en", "s", 1))
        for i in range(1, 6):
            words = list(base)
            for k in (20 * i - 5, 20 * i - 10, 97 - i * 9):
                words[k] = f"y{g}-{i}-{k}"
            rows.append((100 * g + i, " ".join(words), "en", "s", 1))
    taken = []
    once = sorted(tuple(r) for r in near_dedup.near_duplicates(frame(spark, rows)).collect())
    made = near_dedup.materialize

    def kept(df, label, *a):
        out = made(df, label, *a)
        if label in ("nd-reps", "nd-sets", "nd-buckets"):
            taken.append((label, out.count(), out.select(out.columns[0]).distinct().count()))
        return out

    monkeypatch.setattr(near_dedup, "materialize", kept)
    near_dedup.near_duplicates(frame(spark, rows)).collect()
    single, taken[:] = list(taken), []
    twice = near_dedup.near_duplicates(frame(spark, rows + rows)).collect()
    assert sorted(map(tuple, twice)) == sorted(once + once)
    # Each text is represented once, and no bucket is lost.
    assert [x for x in taken if x[0] in ("nd-reps", "nd-buckets")] == [x for x in single if x[0] in ("nd-reps", "nd-buckets")]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 1000):
        a = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        x, y = near_dedup.sketch(np.unique(a[: int(1.5 * n) or 1])), near_dedup.sketch(np.unique(a[int(0.5 * n) :]))
        assert len(x) == near_dedup.COORDS
        if n == 1000:
            assert abs((x == y).mean() - 0.5) < 0.15
    assert (near_dedup.sketch(a) == near_dedup.sketch(a[::-1])).all()


def test_mixing_targets(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(0, 60)), "en", rng.choice(["a", "b", "b", "b", "b", "c", None]), 1) for i in range(900)]
    got = mixing.mix_plan(frame(spark, rows)).collect()
    total = Counter()
    for _, t, _, s, _ in rows:
        total[s] += len(words_of(t))
    names = sorted(k for k in total if k) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(total.values())
    while True:  # share, cap, reshare
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * total[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= target[s]
        free -= over
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == total[r.source]
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 60
    again = mixing.mix_plan(frame(spark, rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    copies = {r.doc_id: r.copies for r in got}
    mixed = mixing.mix(frame(spark, rows, extra=False))
    assert mixed.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})


def test_sharding_moves_rows_only_into_the_new_shard(spark):
    rows = [(i, "x" * (i % 50), "en", "s", 1) for i in range(2000)]
    got = sharding.shard(frame(spark, rows)).collect()

    def jump(key, n):
        b, j, chain = 0, 0, key
        while j < n:
            b = j
            chain = hashlib.md5(chain.encode()).hexdigest()
            j = int((b + 1) * (2.0**31 / ((int(chain[:8], 16) >> 1) + 1)))
        return b

    slots = defaultdict(list)
    for r in got:
        assert (r.shard, r.grown_shard) == (jump(str(r.doc_id), 40), jump(str(r.doc_id), 41))
        assert r.grown_shard in (r.shard, 40)
        assert r.size == r.doc_id % 50 + 16 and r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 50)) and r.law == "key"
        slots[r.shard].append(r.slot)
    assert len(slots) == 40 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 20 < sum(r.grown_shard == 40 for r in got) < 90


def test_secret_layers():
    secret = "password=abcdef123456XY"
    url = urllib.parse.quote(secret, safe="")
    b64 = base64.b64encode(secret.encode()).decode()
    packed = base64.b64encode(gzip.compress(zlib.compress(b64.encode()))).decode()
    for code in ("".join(f"\\u{ord(c):04x}" for c in secret), "".join(f"%{ord(c):02X}" for c in url), b64, base64.b64encode(b64.encode()).decode(), packed, f"x {url} y"):
        text = f"é {code} end"
        found = secret_scan.find_secrets(text)
        start, end = text.index(url if "x " in code else code), text.index(" end") - (2 if "x " in code else 0)
        assert ("assign", start, end) in {x[:3] for x in found}, code
        assert any(x[4] == secret for x in found)
    plain = 'TOKEN: "AKIAABCDEFGHIJKLMN" ' + "0123456789abcdef" + " AKIAABC secret=short"
    assert [x[:3] for x in secret_scan.find_secrets(plain)] == [("assign", 0, 26), ("access", 8, 26), ("hex", 28, 44)]
    assert secret_scan.find_secrets("ſecret=abcdefghijklmnop") == [] and secret_scan.find_secrets(None) == []


def test_every_secret_of_one_layer_is_found():
    secrets = [f"password=abcdef12345{k}XY" for k in range(5)]
    inner = "\n".join([*secrets, secrets[0], "a%20b token%3Dabcdef1234567"])
    for data, via in ((inner.encode(), "base64"), (gzip.compress(inner.encode()), "base64+unpack")):
        code = base64.b64encode(data).decode()
        found = secret_scan.find_secrets(f"x {code} y")
        assert [x[:3] for x in found] == [("assign", 2, 2 + len(code))] * 7
        assert Counter(x[4] for x in found) == Counter([*secrets, secrets[0], "token=abcdef1234567"])
        assert Counter(x[3] for x in found) == {via: 6, f"{via}>url": 1}


def test_layers_are_read_whole(monkeypatch):
    secret, rng = "password=abcdef123456XY", random.Random(3)
    noise = " ".join(f"{rng.random()}" for _ in range(60))
    inner = f"{noise} {secret} {noise}"
    wrap = lambda data, sep="\n": sep.join(re.findall(".{1,64}", base64.b64encode(data).decode()))
    b64 = lambda data: base64.b64encode(data).decode()
    quoted = urllib.parse.quote(gzip.compress(inner.encode()))
    half = gzip.compress((inner + " ".join(f"{rng.random()}" for _ in range(600))).encode())
    texts = {
        "wrapped": wrap(inner.encode()), "crlf": wrap(inner.encode(), "\r\n"), "literal": wrap(inner.encode(), "\\n"), "gzip": wrap(gzip.compress(inner.encode())),
        "prose": f"a line ending in internationalisation\n{wrap(inner.encode())}\nand so on", "members": b64(gzip.compress(b"one") + bz2.compress(inner.encode())),
        "latin": b64(inner.encode() + b"\xe9"), "utf16": b64(inner.encode("utf-16")), "colour": b64(b"\x1b[1m" + inner.encode()), "percent": quoted,
        "short": b64(half[: len(half) * 2 // 3]),
    }
    for name, code in texts.items():
        got = [x for x in secret_scan.find_secrets(f"x {code} y") if x[4] == secret]
        assert len(got) == 1 and got[0][5] == (name == "short"), (name, got)
    monkeypatch.setattr(secret_scan, "PIECE", 1000)
    monkeypatch.setattr(secret_scan, "WINDOW", 4000)
    monkeypatch.setattr(secret_scan, "MARGIN", 400)
    many = "".join(f"{noise[:100]} password=abcdef{k:06d}XY " for k in range(500))
    for data in (many.encode(), many.encode("utf-16")):
        got = [x for x in secret_scan.find_secrets(b64(gzip.compress(data))) if x[0] == "assign"]
        assert sorted(x[4] for x in got) == [f"password=abcdef{k:06d}XY" for k in range(500)] and not any(x[5] for x in got)


def test_secret_scan_of_plain_text_is_the_base_patterns(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in secret_scan.secret_digests(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for doc_id, text in rows:
        base = [(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 12]
        base += [(m.start(), 1, m.end()) for m in secret_scan.ACCESS.finditer(text) if len(m[0]) >= 18]
        base += [(m.start(), 2, m.end()) for m in secret_scan.HEX.finditer(text) if len(m[0]) >= 16]
        line = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base))
        assert got[doc_id].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (got[doc_id].n_assign, got[doc_id].n_access, got[doc_id].n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))


def test_contamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 11, 30]), 60)) for i in range(30)] + [(98, ""), (99, None), (97, "É é Word-two 3")]
    rows = []
    for i in range(120):
        t = prose(rng, 80, 60)
        if i % 3 == 0:
            t += " " + rng.choice(items[:30])[1].upper() + " " + prose(rng, 5)
        rows.append((i, t + (" é, É é WORD two! 3" if i % 40 == 0 else ""), "en", "s", 1))
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for item, t in items:
        w = words_of(t, pattern)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(item))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(frame(spark, rows), table).collect()}

    def expected(t):
        w, hit, ids = words_of(t, pattern), set(), set()
        for win, who in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= who
        return len(w), len(hit), sorted(ids)

    for i, t, *_ in rows:
        assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == expected(t)
    monkeypatch.setattr(decontaminate, "HOT", 3)  # lists of almost every term dealt by document
    assert {r.doc_id: r for r in decontaminate.contamination(frame(spark, rows), table).collect()} == got

    seen, pairs = Counter(w for _, t, *_ in rows for w in words_of(t, pattern)), {}
    for item, t in items:
        known = sorted({w for w in words_of(t, pattern) if w in seen}, key=lambda w: (seen[w], w))
        if len(known) > 1:
            pairs[item] = known[:2]
    for i, t, *_ in rows:
        at = defaultdict(list)
        for k, w in enumerate(words_of(t, pattern)):
            at[w].append(k)
        assert got[i].n_near == sum(any(abs(x - y) <= 8 for x in at[a] for y in at[b]) for a, b in pairs.values())


def test_contamination_without_items_and_in_repeated_ids(spark):
    docs = frame(spark, [(1, "a b c", "en", "s", 1), (1, "x y z", "en", "s", 1), (1, "a b c", "en", "s", 1), (None, "q a b c", "en", "s", 1), (None, None, "en", "s", 1)])
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(r.n_hit, r.n_items, r.n_near, r.contaminated) for r in decontaminate.contamination(docs, none).collect()} == {(0, 0, 0, False)}
    items = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "y")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, items).collect())
    assert got == [(0, 0, 0, 0), (0, 4, 3, 1), (1, 3, 1, 0), (1, 3, 3, 1), (1, 3, 3, 1)]


def test_index_keeps_what_phrases_and_probes_use(spark):
    docs = frame(spark, [(1, "alpha x x beta", "en", "s", 1), (2, "alpha " + "x " * 20 + "beta", "en", "s", 1), (3, "x x", "en", "s", 1), (4, "y beta x", "en", "s", 1)])
    words = decontaminate.words_table(docs)
    terms = spark.createDataFrame([("alpha",)], "term string")
    index = decontaminate.positional_index(words, terms, spark.createDataFrame([("beta x", 2)], "gram string, width int"))
    assert sorted((r.doc_id, r.term, r.positions) for r in index.collect()) == [(1, "alpha", [0]), (2, "alpha", [0]), (4, "beta", [1]), (4, "x", [2])]
    both = spark.createDataFrame([("alpha",), ("beta",)], "term string")
    index = decontaminate.positional_index(words, both, spark.createDataFrame([], "gram string, width int"))
    probes = spark.createDataFrame([("5", "beta", "alpha")], "item_id string, first string, second string")
    assert [tuple(r)[:1] + tuple(r)[2:] for r in decontaminate.proximity_matches(index, probes, 5).collect()] == [(1, "5", 3, 0)]


def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(got) == docs.count() and len(held) > 100
    assert np.mean([r.predicted == q for r, q in held]) > 0.95
    assert all(quality_classifier.crc_is_held_out(r.doc_id) == r.held_out and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_trees_traverse_like_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality_classifier.fit_trees(x, y, trees=20, depth=3, rate=0.3)
    got = model.scores(x)
    assert ((got >= 0.5) == y).mean() > 0.95
    for row, s in list(zip(x, got, strict=True))[:20]:
        margin = model.base
        for t in range(20):
            at = 0
            for _ in range(3):
                at = 2 * at + 1 + int(row[model.feature[t, at]] > model.threshold[t, at])
            margin += model.value[t, at - 7]
        assert s == pytest.approx(1 / (1 + np.exp(-margin)))


def test_rules_base_counts(spark):
    rng = random.Random(9)
    texts = [prose(rng, n, v) for n in (0, 2, 3, 60, 200) for v in (3, 30, 3000)] + ["a#b\n\n a#b\na#b \na#b", "x\n" * 60, "é | $ <&> é\té"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    for r in quality_rules.quality_rules(frame(spark, rows)).collect():
        t = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(grams)
        inside = {p for k, g in enumerate(grams) if n[g] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))


def test_robust_outliers(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 120, 2000), "en", "s", 1) for i in range(200)] + [(1000 + i, prose(rng, 120, 2000).upper() + " #" * 40, "en", "s", 1) for i in range(30)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    assert all(got[i].kept for i in range(200)) and not any(got[1000 + i].kept for i in range(30))


def test_moderate_repetition_is_an_outlier(spark):
    """In a group where nothing repeats, in a small source that leans on its language, and in a table too small for covariances."""
    rng = random.Random(14)

    def text(repeats=0.0, lines=0.0, symbols=0):
        words = prose(rng, 200, 10**6).split()
        rows = [" ".join(words[k : k + 10]) for k in range(0, 200, 10)]
        if repeats:  # whole lines again, the line breaks moved, so that only windows repeat
            again = " ".join(rows[: int(10 * repeats)])
            rows = [again, *rows[int(20 * repeats) :], again + " end"]
        return "\n".join(rows + ["so"] * round((lines * len(rows) + 1) / (1 - lines) if lines else 0)) + " #" * symbols

    bad = [dict(repeats=0.3), dict(repeats=0.4), dict(lines=0.3), dict(repeats=0.4, lines=0.4), dict(symbols=30)]
    clean = [(i, text(), "en", "s", 1) for i in range(200)] + [(200 + i, text(), "en", "small", 1) for i in range(5)]
    rows = clean + [(1000 + i, text(**k), "en", s, 1) for s in ("s", "small") for i, k in enumerate(bad)] + [(1100 + i, text(**k), "xx", None, 1) for i, k in enumerate(bad)]
    for table in (rows, rows[:40] + rows[205:210]):
        got = quality_rules.quality_rules(frame(spark, table)).collect()
        assert all(not r.base_failed and r.distance is not None for r in got)
        assert {(r.doc_id, r.source) for r in got if r.kept} == {(r[0], r[3]) for r in table if r[0] < 1000}


def test_token_counts_match_the_library(spark):
    path = token_count.default_path()
    counter = token_count.TokenCounter(open(path).read())
    rng = random.Random(8)
    parts = ["a", "Word", " ", "  ", "\n", "\t", "'s", "'", "12", "é", "日本", "\x1c", "\x85", "\xa0", "<|endoftext|>", "_", "²", "!?", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)] + ["x" * 5000]
    want = [len(e.ids) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == want
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in token_count.token_counts(docs, path).collect()}
    for r in docs.collect():
        n = len(counter.tokenizer.encode(r.text, add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len(r.text.encode()), n > 512)


def test_licenses():
    index = license_scan.TemplateIndex(license_scan.TEMPLATES)
    mit = license_scan.TEMPLATES["MIT"]
    words = mit.split()
    edited = " ".join(w for k, w in enumerate(words) if k % 17)  # one word in seventeen is gone
    for text in (f"é before {mit} after", f"before {edited} after"):
        found = [x for x in license_scan.scan_text(text, index) if x[0] == "MIT"]
        assert len(found) == 1 and found[0][1] > 0.9
        assert text[found[0][2] :].startswith(("Permission", "is hereby")) and text[: found[0][3]].endswith(("NONINFRINGEMENT",))
    for name in license_scan.TEMPLATES:
        text = f"lorem ipsum. {license_scan.TEMPLATES[name]} dolor"
        assert name in {x[0] for x in license_scan.scan_text(text, index)}
    assert license_scan.scan_text("the license was permission to use", index) == [] and license_scan.scan_text(None, index) == []
    twice = f"{license_scan.TEMPLATES['MIT-short']} and so on and so forth. {license_scan.TEMPLATES['MIT-short']}"
    assert len(license_scan.scan_text(twice, index)) == 2


def test_licenses_with_insertions_and_changed_words():
    index = license_scan.TemplateIndex(license_scan.TEMPLATES)
    mit = license_scan.TEMPLATES["MIT"]
    extra = "The Software shall be used for Good, not quite Evil."
    text = f"before {mit.replace('THE SOFTWARE IS', extra + ' THE SOFTWARE IS')} after"
    found = [x for x in license_scan.scan_text(text, index) if x[0] == "MIT"]
    assert found == [("MIT", 1.0, 7, len(text) - 7)]
    rng = random.Random(12)
    for k in range(30):  # whatever stands around the four words
        text = f"{prose(rng, 20)} issued{k} under the MIT License. {prose(rng, 20)}"
        assert [x[:2] for x in license_scan.scan_text(text, index) if x[0] == "MIT-short"] == [("MIT-short", 0.8)]


def test_alignment_is_the_longest_common_subsequence_of_the_band():
    rng = random.Random(6)
    for _ in range(50):
        a = [rng.choice("abcd") for _ in range(12)]
        b = [rng.choice("abcd") for _ in range(14)]
        table = np.zeros((13, 15), int)
        for i in range(12):
            for j in range(14):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert license_scan.align(a, b, 0, band=30)[0] == table[-1, -1]


def test_warc_round_trip(spark, tmp_path):
    pages = [(5, "http://a.example/x?y#z", "<p>same</p>"), (3, "http://b.example/", "<p>same</p>"), (9, None, None), (8, "no scheme", ""), (7, "http://c.example", "é\r\n\r\nWARC/1.1\r\n\r\n"), (3, "http://b.example/", "<p>same</p>"), (None, "u\r\nv", "lone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as sha", "2 as body", "3 as copy", "4 as salt", "5 as r_sha", "6 as record_id", "7 as n_bytes")
    path = f"file://{tmp_path}/warc"
    warc.write_archives(df, path)
    records = warc.read_archives(spark, path)
    captures = warc.assemble(records)
    rows = captures.collect()
    assert len(rows) == 7 and all(r.n_requests == 1 and r.n_metadata == 1 and r.request.head.startswith("GET ") for r in rows)
    payloads = sorted(bytes(r.capture.payload).decode() for r in rows if r.capture.type == "response")
    assert payloads == sorted(["<p>same</p>", "", "é\r\n\r\nWARC/1.1\r\n\r\n", "lone"])
    assert all(r.capture.computed_digest == r.capture.payload_digest for r in rows if r.capture.type == "response")
    got = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.capture_pages(captures).collect()), key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    same, none, odd = digest("<p>same</p>"), digest(""), "é\r\n\r\nWARC/1.1\r\n\r\n"
    assert got == sorted([
        (3, 11, same, "response", None), (3, 11, same, "revisit", 3), (5, 11, same, "revisit", 3), (8, 0, none, "response", None), (9, 0, none, "revisit", 8),
        (7, len(odd.encode()), digest(odd), "response", None), (-1, 4, digest("lone"), "response", None),
    ], key=str)
    assert all(r.digest_ok for r in warc.capture_pages(captures).collect())
    archive = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("part*.gz"))
    (tmp_path / "damaged").mkdir()
    (tmp_path / "damaged" / "a.warc").write_bytes(archive.replace(b"<p>same</p>", b"<p>sane</p>").replace(b"page-id: 7", b"page-id: 6"))
    found = {r.page_id: r for r in warc.capture_pages(warc.assemble(warc.read_archives(spark, f"file://{tmp_path}/damaged"))).collect()}
    assert not found[5].digest_ok and found[5].payload_digest == digest("<p>sane</p>") and found[6].digest_ok and not found[3].digest_ok
    empty = f"file://{tmp_path}/empty"
    warc.write_archives(df.limit(0), empty)
    assert warc.capture_pages(warc.assemble(warc.read_archives(spark, empty))).count() == 0


def test_warc_frames_and_a_long_page(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 1000)
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    pages = [(i, f"http://a.example/{i}", "x" * (2_000_000 if i == 5 else 100 * i)) for i in range(40)]
    path = f"file://{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    assert len(list((tmp_path / "warc").glob("part*.gz"))) > 5
    rows = warc.capture_pages(warc.assemble(warc.read_archives(spark, path))).collect()
    assert {r.page_id: r.payload_bytes for r in rows} == {i: len(t) for i, _, t in pages} and all(r.digest_ok for r in rows)


def test_hashes_of_shingles_follow_the_words():
    text = "Alpha beta  GAMMA\tdelta epsilon zeta".encode()
    assert len(near_dedup.shingle_set(text)) == 2 and len(near_dedup.shingle_set(b"a b c d")) == 1 and len(near_dedup.shingle_set(None)) == 0
    assert (near_dedup.shingle_set(text) == near_dedup.shingle_set(text.lower())).all()
    assert near_dedup.shingle_set(b"a b")[0] == xxhash.xxh64_intdigest(b"a b")


@pytest.mark.parametrize("shrink", [0, quality_rules.SHRINK])
def test_estimate_has_the_least_determinant(spark, monkeypatch, shrink):
    """Concentration against all subsets of a small table, without and with the wider estimate: the determinant is the least one, where
    outliers stand apart."""
    monkeypatch.setattr(quality_rules, "SHRINK", shrink)
    names = list(quality_rules.VECTOR)
    for seed in range(2):
        rng = np.random.default_rng(seed)
        x = np.vstack([rng.normal([1.5, 0.2, 0.1, 0.2, 0.1], 0.02, (9, 5)), rng.normal([1.6, 0.8, 0.7, 0.6, 0.5], 0.02, (3, 5))])
        rows = spark.createDataFrame([(None, None, *map(float, v)) for v in x], "own string, whole string, " + ", ".join(f"{c} double" for c in names))
        tree = spark.createDataFrame([("table", None, 0, len(x))], "grp string, parent string, depth int, n long")
        got = quality_rules.robust_estimates(rows, tree).collect()
        assert len(got) == 1
        w = np.zeros((5, 5))
        for i in range(5):
            for j in range(i + 1):
                w[i, j] = got[0][f"w_{i}_{j}"]
        lo, mid, hi = (np.sort(x, axis=0)[k] for k in (2, 5, 8))
        edge = lambda v: (np.floor(v / quality_rules.BIN) + 0.5) * quality_rules.BIN
        floor = np.diag([v**2 for v in quality_rules.VECTOR.values()])
        wide = np.diag(((edge(hi) - edge(lo)) / 1.349) ** 2) + floor
        share = len(x) ** 2 / (len(x) ** 2 + shrink**2)
        blend = lambda part: share * (np.cov(part.T, bias=True) + floor) + (1 - share) * wide
        least = min(np.linalg.slogdet(blend(x[list(c)]))[1] for c in itertools.combinations(range(12), 9))
        center = share * x[:9].mean(axis=0) + (1 - share) * edge(mid)
        assert -2 * np.log(np.diag(w)).sum() == pytest.approx(least, abs=1e-6)
        assert [got[0][f"m_{i}"] for i in range(5)] == pytest.approx(center, abs=1e-9)


def test_every_language_and_source_has_its_estimate(spark):
    """From LEAST_GROUP rows on a group leans on its own rows, and the more so the more it has."""
    rng = random.Random(3)
    shout = lambda: prose(rng, 120, 2000).upper()
    rows = [(i, prose(rng, 120, 2000), "en", "s", 1) for i in range(300)] + [(1000 + i, shout(), "en", "loud", 1) for i in range(300)]
    rows += [(2000 + i, shout(), "en", f"loud{i}", 1) for i in range(3)] + [(3000, prose(rng, 120, 2000), "en", "loud", 1)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    assert all(got[i].kept for i in range(300)) and all(got[1000 + i].kept for i in range(300)) and not got[3000].kept


def test_encoded_parts_behind_slashes_and_other_words():
    key = "AKIA" + "Q7" * 8
    inner = base64.b64encode(f"id {key} end".encode()).decode()
    packed = base64.b64encode(gzip.compress(f"key {key} end".encode() * 3)).decode()
    for front in ("", "/", "a/", "ab/", "abc/", "path/to/", "x_y-z/"):
        for code in (inner, packed):
            found = secret_scan.find_secrets(f"see {front}{code} there")
            assert any(x[0] == "access" and x[4].startswith(key) for x in found), (front, code)
            assert all(4 <= x[1] < x[2] <= 4 + len(front + code) for x in found)
    for text in (f"\f{key} x", "é" * 3 + key):  # odd characters and other encodings
        assert any(x[4] == key for x in secret_scan.find_secrets(base64.b64encode(text.encode("latin-1")).decode()))
    two = [f"AKIA{'AB' * 7}{k}" for k in "XY"]
    got = {x[4] for x in secret_scan.find_secrets(base64.b64encode(" ".join(two).encode()).decode())}
    assert set(two) <= got
    members = gzip.compress(b"first") + gzip.compress(key.encode())
    assert any(x[4] == key for x in secret_scan.find_secrets(base64.b64encode(members).decode()))


def test_short_licenses_against_all_alignments(spark):
    """Edits of every template at random: what aligns at coverage anywhere is found."""
    index = license_scan.TemplateIndex(license_scan.TEMPLATES)
    rng = random.Random(5)
    assert license_scan.scan_text("Released under an MIT License.", index)[0][:2] == ("MIT-short", 0.8)
    for name, text in license_scan.TEMPLATES.items():
        words = license_scan.tokens(text)
        t = index.names.index(name)
        for k in range(12):
            changed = [w if rng.random() > 0.03 * (k % 5) else f"q{rng.randrange(99)}" for w in words]
            doc = prose(rng, rng.randrange(9)).split() + changed + prose(rng, rng.randrange(9)).split()
            best = max(license_scan.align(words, doc, d)[0] for d in range(-3, len(doc) - len(words) + 4))
            got = [m for m in license_scan.scan_text(" ".join(doc), index) if m[0] == name]
            assert bool(got) == (best >= license_scan.COVERAGE * len(words)), (name, k)
            assert t >= 0
    table = spark.createDataFrame([("own", "all rights are given away"), (None, "x"), ("none", None)], "license string, text string")
    docs = frame(spark, [(1, "here all rights are given away now", "en", "s", 1), (2, None, "en", "s", 1)])
    assert [(r.doc_id, r.license, r.coverage) for r in license_scan.license_matches(docs, table).collect()] == [(1, "own", 1.0)]


def test_unicode_escapes_in_all_forms():
    secret = "password=abcdef123456XY"
    forms = ("\\u{{{:x}}}", "\\U{:08x}", "\\\\u{:04x}", "\\\\\\\\x{:02x}", "&amp;#x{:x};", "&amp;amp;#{:d};", "%u{:04x}")
    for form in forms:
        code = "".join(form.format(ord(c)) for c in secret)
        found = secret_scan.find_secrets(f"a {code} b")
        assert ("assign", 2, 2 + len(code), "unicode", secret, False) in found, form


def test_long_runs_take_time_in_proportion():
    """Lines of a million characters: an inline image, and what each pattern could go back over."""
    rng = random.Random(6)
    image = base64.b64encode(rng.randbytes(750_000)).decode()
    lines = "\n".join(re.findall(".{1,76}", image))
    stuck = ("A" * 10**6, "A" * 15 + " " * 10**6, "password" + " " * 10**6, "\\" * 10**6, "&amp;" * 200_000, "%41" * 300_000, "x%01" * 250_000, "AKIA" * 250_000, "a\n" * 500_000)
    for text in (f"data:image/png;base64,{image}", lines, *stuck):
        began = time.perf_counter()
        secret_scan.find_secrets(text)
        assert time.perf_counter() - began < 20, text[:40]
    assert any(x[4] == "password=abcdef123456XY" for x in secret_scan.find_secrets(f"{lines[:19_250]}\n{base64.b64encode(b'  password=abcdef123456XY').decode()}\n"))


def test_classifier_takes_one_text_of_an_id(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 80, 500) if i % 2 else "# " * 60, "en", "s", 1) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    plain = quality_classifier.train(frame(spark, rows), labels)
    more = [r for r in rows for _ in range(5)]
    again = quality_classifier.train(frame(spark, more[::-1]), labels)
    x = np.random.default_rng(1).random((50, len(quality_classifier.FEATURES))).astype(np.float32)
    assert (plain.scores(x) == again.scores(x)).all()
