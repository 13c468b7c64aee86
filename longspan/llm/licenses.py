"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates and documents are lower-cased words of letters and digits. Of a template's hashes of ``GRAM`` words in a row,
winnowing keeps the smallest of each ``WINNOW`` neighbours; an inverted index holds them. Every gram of a document is
looked up, so a shared passage of GRAM + WINNOW - 1 words can't be missed. Of a template of fewer than ``SHORT`` words
all grams are held, of one of fewer than ``LINE`` words all pairs, of which a place must show nearly as many as one changed
word leaves, so a line with a word changed is found, too. Hits on neighbouring diagonals of a template,
no further apart than twice the band, form one candidate, which a banded local alignment scores. Alignments of a template
that follow each other in both texts, a clause or name of some length inserted between them, are one match. Matches that
cover at least ``coverage`` of their template are reported with their spans. The index is a constant of the library's size; documents are read once, without a
shuffle, and a worker holds one batch.

Defined results: null and empty texts match nothing; rows that repeat are reported each for itself; null ids are
returned; each place of a template is a row; of candidates of a template that share words the one of higher coverage
stays; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.llm.common import table

GRAM = 3
WINNOW = 4
#: Words below which all grams of a template are held, and below which pairs are.
SHORT, LINE = 25, 8
COVERAGE = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1
WORD = re.compile(r"[^\W_]+")

WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
# The public texts of licenses and of the notices that name them.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": BSD_CONDITIONS,
    "BSD-3-Clause-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + WARRANTY,
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Index:
    """Winnowed grams of templates by their code, with (template, position) postings."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.number: dict[str, int] = {}
        self.texts = [np.array([self.number.setdefault(w, len(self.number)) for w in words(t)], np.int64) for t in templates.values()]
        postings: dict[int, dict[int, list[tuple[int, int]]]] = {GRAM: defaultdict(list), 2: defaultdict(list)}
        for t, text in enumerate(self.texts):
            gram = 2 if len(text) < LINE else GRAM
            code = self.codes(text, gram)
            order = self._spread(code)
            width = max(1, min(WINNOW, len(code))) if len(text) >= SHORT else 1
            for at in sorted({lo + int(order[lo : lo + width].argmin()) for lo in range(len(code) - width + 1)}):
                postings[gram][int(code[at])].append((t, at))
        self.held = [(gram, np.array(sorted(p), np.int64), [p[c] for c in sorted(p)]) for gram, p in postings.items() if p]

    def least_hits(self, t: int) -> int:
        """Hits that a place of a template needs: of pairs as many as one changed word leaves."""
        return max(1, len(self.texts[t]) - 3) if len(self.texts[t]) < LINE else 1

    def codes(self, ids: np.ndarray, gram: int) -> np.ndarray:
        """Codes of the grams at each position; -1 where a word is in no template."""
        n = len(ids) - gram + 1
        if n <= 0:
            return np.empty(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(gram):
            code = code * (len(self.number) + 1) + ids[k : k + n]
            known &= ids[k : k + n] >= 0
        return np.where(known, code, -1)

    @staticmethod
    def _spread(code: np.ndarray) -> np.ndarray:
        x = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    def hits(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """(document position, template position) by template."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for gram, kept, postings in self.held:
            code = self.codes(ids, gram)
            at = np.minimum(np.searchsorted(kept, code), len(kept) - 1)
            for p in np.flatnonzero(kept[at] == code).tolist() if len(code) else []:
                for t, q in postings[at[p]]:
                    out[t].append((p, q))
        return out


def align(template: np.ndarray, doc: np.ndarray, low: int, high: int) -> tuple[int, int, int, int, int]:
    """(matched words, first, past the last position in doc, the same in template) of the best local alignment on diagonals low to high."""
    width = high - low + 1
    slope = -GAP * np.arange(width)
    score = np.zeros((len(template) + 1, width), np.int32)
    for i, w in enumerate(template, 1):
        j = i - 1 + low + np.arange(width)  # the document position that meets this word on each diagonal
        inside = (j >= 0) & (j < len(doc))
        same = inside & (doc[np.clip(j, 0, len(doc) - 1)] == w)
        step = score[i - 1] + np.where(same, MATCH, MISMATCH)
        skip = np.concatenate([score[i - 1][1:], [0]]) + GAP  # a word of the template alone
        t = np.maximum(0, np.maximum(np.where(inside, step, 0), skip))
        score[i] = np.maximum(0, np.maximum.accumulate(t + slope) - slope)
    i, d = (int(x) for x in np.unravel_index(int(score.argmax()), score.shape))
    matched, last, first, begin, end = 0, None, 0, 0, 0
    while i > 0 and score[i, d] > 0:
        j = i - 1 + low + d
        same = 0 <= j < len(doc) and doc[j] == template[i - 1]
        if 0 <= j < len(doc) and score[i, d] == score[i - 1, d] + (MATCH if same else MISMATCH):
            if same:
                matched, first, begin = matched + 1, j, i - 1
                if last is None:
                    last, end = j + 1, i
            i -= 1
        elif d + 1 < width and score[i, d] == score[i - 1, d + 1] + GAP:
            i, d = i - 1, d + 1
        elif d > 0 and score[i, d] == score[i, d - 1] + GAP:
            d -= 1
        else:
            break
    return matched, first, last or 0, begin, end


def chain(parts: list[tuple[int, int, int, int, int]], most_apart: int) -> list[tuple[int, int, int]]:
    """(matched, first, past last) of alignments, and of runs of them in order in both texts and at most most_apart words apart; the best first."""
    parts = sorted(set(parts), key=lambda m: (m[1], m[2]))
    longest = max((m[2] - m[1] for m in parts), default=0)
    best: list[tuple[int, int]] = []  # matched in all up to a part, and where its run begins
    for k, (n, first, _, begin, _) in enumerate(parts):
        own, start = n, first
        for j in range(k - 1, -1, -1):
            if parts[j][1] < first - most_apart - longest:  # none before it ends near enough
                break
            if parts[j][2] <= first <= parts[j][2] + most_apart and parts[j][4] <= begin and best[j][0] + n > own:
                own, start = best[j][0] + n, best[j][1]
        best.append((own, start))
    runs = [(n, start, m[2]) for (n, start), m in zip(best, parts)]
    return sorted(runs, key=lambda m: (-m[0], m[2] - m[1], m[1]))


def scan(index: Index, text: str | None, coverage: float = COVERAGE) -> list[tuple[str, int, float, int, int, int, int]]:
    """(template, matched, coverage, first word, past last word, first character, past last character) of each match in text."""
    get = index.number.get
    ids = np.array([get(w, -1) for w in words(text or "")], np.int64)
    found: list[tuple[int, int, int, int]] = []
    for t, hits in index.hits(ids).items():
        template = index.texts[t]
        band = min(16, max(1, len(template) // 4))
        places = Counter(p - q for p, q in hits)
        diagonals = sorted(places)
        begin, mine = 0, []
        for k in range(1, len(diagonals) + 1):
            if k == len(diagonals) or diagonals[k] - diagonals[k - 1] > band or diagonals[k] - diagonals[begin] > 2 * band:
                enough = sum(places[x] for x in diagonals[begin:k]) >= index.least_hits(t)
                m = align(template, ids, diagonals[begin] - band, diagonals[k - 1] + band) if enough else (0,)
                begin = k
                if m[0] >= GRAM:
                    mine.append(m)
        for m in chain(mine, len(template)):
            if m[0] < coverage * len(template):
                break
            if all(f[0] != t or m[2] <= f[2] or m[1] >= f[3] for f in found):
                found.append((t, *m))
    if not found:
        return []
    spans = [m.span() for m in WORD.finditer(text.lower())]
    return sorted((index.names[t], n, n / len(index.texts[t]), a, b, spans[a][0], spans[b - 1][1]) for t, n, a, b in found)


SCHEMA = "doc_id long, license string, matched int, coverage double, first_word int, end_word int, first_char int, end_char int"


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row per place in docs that covers a template: see SCHEMA; spans end before end_word and end_char of the lower-cased text."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates or TEMPLATES)
        for b in batches:
            rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in scan(index, t, coverage)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, SCHEMA)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(table(spark, sf_dir, "documents"))


QUERIES = {"op2_licenses": op2_licenses}
ORACLE_SQL: dict[str, str] = {}
