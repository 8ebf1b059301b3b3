"""Licence scans: winnowed fingerprints in an inverted index pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a fingerprint, fingerprints in a winnowing window: any run of GRAM + WINDOW - 1 = 5 equal words leaves a common fingerprint.
GRAM, WINDOW = 3, 3
#: Words by which an alignment may drift from its diagonal, and the share of a template that a match must cover.
BAND, COVERAGE = 8, 0.8
#: Templates of fewer words are looked up by single words, since a match of few words may share no run of words with them.
SHORT = 15
#: Letters of all templates together, at most: the index goes to every task.
MOST_LETTERS = 50_000_000
_TOKEN = re.compile(r"[^\W_]+")

#: Public licence notices and texts.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT-short": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare '
        "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The "
        "copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following "
        "disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such "
        "copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        "under copyright law."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}


def tokens(text: str) -> list[str]:
    """Lower-case words of letters and digits."""
    return [w.lower() for w in _TOKEN.findall(text)]


def fingerprints(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed fingerprints of a word-hash sequence and their positions: the smallest (rightmost of equal) of every window."""
    g = grams(hashes)
    n = len(g)
    if n < 1:
        return g, np.empty(0, np.int64)
    if n <= WINDOW:
        at = np.array([n - 1 - int(g[::-1].argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(g, WINDOW)[:, ::-1]
        at = np.unique(np.arange(len(view)) + WINDOW - 1 - view.argmin(axis=1))
    return g[at], at


def grams(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM words."""
    n = len(hashes) - GRAM + 1
    if n < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        g = hashes[:n].copy()
        for i in range(1, GRAM):
            g = (g ^ (g >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
        g ^= g >> np.uint64(32)
    return g


class TemplateIndex:
    """Inverted index from fingerprint to (template, position). Every run of GRAM words of a template is kept, since the words around
    it in a document decide which of them that document's winnowing keeps.

    Templates of fewer than SHORT words are found by single words: a match leaves out at most a (1 - coverage) share of the words, so it holds
    one of any set larger than that. The set is the longest words, as the rarest guess."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE) -> None:
        self.names = sorted(templates)
        self.words = [tokens(templates[k]) for k in self.names]
        entries: dict[int, list[tuple[int, int]]] = defaultdict(list)
        single: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            h = hashed(words)
            if len(words) < SHORT:
                some = int(len(words) * (1 - coverage) + 1e-9) + 1
                for i in sorted(range(len(words)), key=lambda i: (-len(words[i]), i))[:some]:
                    single[int(h[i])].append((t, i))
            else:
                for i in range(len(words) - GRAM + 1):
                    for g in grams(h[i : i + GRAM]):
                        entries[int(g)].append((t, i))
        self.entries, self.single = dict(entries), dict(single)
        self.keys, self.single_keys = np.array(sorted(entries), np.uint64), np.array(sorted(single), np.uint64)

    def candidates(self, h: np.ndarray) -> dict[int, list[int]]:
        """Template -> diagonals (document position less template position) of common fingerprints, or of a short template's words."""
        every, (_, at) = grams(h), fingerprints(h)
        out: dict[int, list[int]] = defaultdict(list)
        for hashes, keys, entries, places in ((every[at], self.keys, self.entries, at), (h, self.single_keys, self.single, np.arange(len(h)))):
            if len(hashes) and len(keys):
                k = np.searchsorted(keys, hashes)
                for i in np.flatnonzero(keys[np.minimum(k, len(keys) - 1)] == hashes):
                    for t, p in entries[int(hashes[i])]:
                        out[t].append(int(places[i]) - p)
        return out


def hashed(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def align(template: list[str], doc: list[str], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, last document word) of the best alignment of the template with the document within `band` words of
    the diagonal. Words match or are skipped on either side; the longest common subsequence in the band wins, then the earliest
    end, then the latest start."""
    best_row = {}
    for i, word in enumerate(template):
        row = {}
        for j in range(i + diagonal - band, i + diagonal + band + 1):
            options = [best_row.get(j, (0, 0, 0)), row.get(j - 1, (0, 0, 0))]
            if 0 <= j < len(doc) and doc[j] == word:
                n, start, end = best_row.get(j - 1, (0, 0, 0))
                options.append((n + 1, start if n else -j, -j))
            row[j] = max(options, key=lambda x: (x[0], x[2], -x[1]) if x[0] else (0, 0, 0))
        best_row = row
    n, start, end = max(best_row.values(), key=lambda x: (x[0], x[2], -x[1]))
    return n, -start, -end


def scan_text(text: str | None, index: TemplateIndex, coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) of every match, coverage being the matched share of the template's words, start and end code
    points of the text. Of matches of one template that overlap the better stays; a template whose match lies inside
    that of another stays beside it."""
    if not text:
        return []
    words = tokens(text)
    out = []
    candidates = index.candidates(hashed(words))
    spans = [m.span() for m in _TOKEN.finditer(text)] if candidates else []
    for t, diagonals in candidates.items():
        template, kept = index.words[t], []
        last, need = None, Counter(template)
        for d in sorted(set(diagonals)):
            if last is not None and d - last <= BAND // 2:
                continue
            if len(template) < SHORT and (need & Counter(words[max(0, d - BAND) : max(0, d + len(template) + BAND)])).total() < coverage * len(template):
                continue
            last = d
            n, first, end = align(template, words, d)
            if n >= coverage * len(template):
                kept.append((n, first, end))
        kept.sort(key=lambda x: (-x[0], x[2] - x[1], x[1]))
        chosen: list[tuple[int, int, int]] = []
        for m in kept:
            if all(m[2] < c[1] or m[1] > c[2] for c in chosen):
                chosen.append(m)
        # Pieces on several diagonals, as insertions leave them, count together if what lies between them isn't longer than the template.
        wide, last, ds = [], None, sorted(set(diagonals))
        for i, d in enumerate(ds):
            top = ds[bisect_right(ds, d + len(template)) - 1]
            if top - d <= BAND // 2 or last == top and i and d - ds[i - 1] <= BAND // 2:
                continue
            last = top
            around = Counter(words[max(0, d - BAND) : top + len(template) + BAND])
            if (need & around).total() >= coverage * len(template):
                n, first, end = align(template, words, (d + top) // 2, BAND + (top - d + 1) // 2)
                if n >= coverage * len(template):
                    wide.append((n, first, end))
        for m in sorted(wide, key=lambda x: (-x[0], x[2] - x[1], x[1])):
            if all(m[2] < c[1] or m[1] > c[2] for c in chosen):
                chosen.append(m)
        out += [(index.names[t], n / len(template), spans[a][0], spans[b][1]) for n, a, b in chosen]
    return sorted(out, key=lambda x: (x[2], x[0]))


def _given(templates: dict[str, str] | DataFrame | None) -> dict[str, str]:
    """The templates as name -> text; of a table (license, text) only as much is read as may be sent, and more is an error."""
    if isinstance(templates, DataFrame):
        letters = templates.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
        if letters > MOST_LETTERS:
            raise ValueError(f"the templates have {letters} letters, more than {MOST_LETTERS} can't be sent to every task")
        return {r["license"]: r["text"] for r in templates.select("license", "text").where("license is not null and text is not null").collect()}
    return TEMPLATES if templates is None else templates


def license_matches(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Licence templates found in docs (doc_id, text): one row per match with doc_id, license, coverage, start, end (code points, end
    exclusive) and matched (that part of the text).

    Texts are read whole; null and empty texts match nothing. Repeated rows repeat their matches, null ids are kept, an
    empty table gives no rows, other columns are ignored. templates is a dict or a table (license,
    text), else TEMPLATES; its index is sent to every task, so more than MOST_LETTERS are an error.
    """
    index = docs.sparkSession.sparkContext.broadcast(TemplateIndex(_given(templates), coverage))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, cell in enumerate(batch.column(1)):
                text = cell.as_py()
                for name, share, start, end in scan_text(text, index.value, coverage):
                    rows.append(i)
                    found.append((name, share, start, end, text[start:end]))
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "license", "coverage", "start", "end", "matched"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, license string, coverage double, start bigint, end bigint, matched string"
    return docs.select("doc_id", F.col("text")).mapInArrow(scanned, schema)
