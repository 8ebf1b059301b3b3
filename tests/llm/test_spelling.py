"""Spelling variants against comparing all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from lagmill.llm import spelling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_words(docs, length=5, count=3):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= length and c >= count}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    form, rows = {}, []
    close = {w: [v for v in words if near(w, v)] for w in words}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w in words:
        r = w
        while form[r]:
            r = form[r]
        rows.append((w, form[w], r, words[w], len(close[w]), words[form[w]] if form[w] else None))
    return sorted(rows, key=lambda r: r[0])


def test_all_small_words(spark):
    rnd = random.Random(2)
    words = {w: rnd.randint(3, 60) for w in ("".join(rnd.choice("abé") for _ in range(rnd.randint(1, 6))) for _ in range(400))}
    words |= {"aaaaa": 9, "aaaa": 100, "aaaaaa": 2000, "bbbbb": 5}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    formed = spelling.materialize(spelling.forms(table), "test-forms")
    got = sorted(map(tuple, spelling.roots(formed).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert got == brute(words)


def test_texts_match_brute_force(spark):
    rnd = random.Random(5)
    stock = ["letter", "better", "setter", "settler", "Straße", "straßen", "niño", "ninos", "coöperate", "cooperate", "BOOKKEEPER", "kept", "abc×def", "a÷b"]
    docs = [(i, " ".join(rnd.choices(stock, range(1, len(stock) + 1), k=rnd.randint(0, 80))) + rnd.choice(["", ".", " x1letter2_setter"])) for i in range(300)]
    docs += [(None, "letter lettre lettre lettre"), (901, None), (902, ""), (903, "İstanbul KELVIN " * 5), (904, "word" * 5000), (905, "repeat " * 20_000), docs[1], docs[1]]
    table = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, word string, n int")
    got = sorted(map(tuple, spelling.spelling_variants(table).collect()))
    want = brute(brute_words(docs))
    assert got == want and any(r[1] for r in want) and len({r[2] for r in want}) < len(want)
    assert spelling.spelling_variants(table.limit(0)).count() == 0
