"""License notices and whole license texts by winnowed template fingerprints and word alignment.

Templates are kept as an inverted index of winnowed word k-grams. A document's own winnowed k-grams pick
(template, diagonal) candidates. A short notice is aligned word by word in a band around its diagonal. Hits
of a long template are chained in order, the chain's ends are extended word by word, and its words are
matched by longest common subsequence. Reported are the span in the text and the share of all template
words that match in order, so a part of a license has the coverage of that part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortloom.llm.common import texts

K, RUN, BAND = 2, 2, 6
LEAST = 0.8
LONG = 40  # words from which a template counts as a long one, of which parts are reported ...
LEAST_WORDS = 24  # ... if so many words match; its index has grams of LONG_K words, winnowed over LONG_RUN
LONG_K, LONG_RUN = 5, 4
SLACK = 200  # words that may stand between two hits of one long match beyond those of the template
DROP = 8  # words without a match that end the extension of a long match

# Short public notices.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, "
    "are permitted provided that the following conditions are met",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
    "software and associated documentation files",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
    "without fee is hereby granted",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd-license": "Released under the BSD License.",
    "isc-license": "Released under the ISC License.",
} | {
    f"cc-{kind}-{version}": f"Licensed under CC {kind.upper()} {version}."
    for kind in ("by", "by-sa", "by-nd", "by-nc-sa", "by-nc-nd")
    for version in ("3.0", "4.0")
} | {"cc-by-nc-3.0": "Licensed under CC BY-NC 3.0."}

_WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
)


def _gnu(name: str, version: str) -> str:
    return (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        f"{name} as published by the Free Software Foundation, either version {version} of the License, or "
        f"(at your option) any later version. {_WARRANTY}{name} for more details."
    )


# The headers that the licenses recommend for source files.
HEADERS = {
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
    "file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
    "permissions and limitations under the License.",
    "gpl-2.0-header": _gnu("GNU General Public License", "2"),
    "gpl-3.0-header": _gnu("GNU General Public License", "3"),
    "lgpl-2.1-header": _gnu("GNU Lesser General Public License", "2.1"),
    "lgpl-3.0-header": _gnu("GNU Lesser General Public License", "3"),
    "agpl-3.0-header": _gnu("GNU Affero General Public License", "3"),
}


def _whole_texts() -> dict[str, str]:
    found = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in found}


#: Short notices, file headers and whole texts; callers pass them to the tasks.
TEMPLATES = NOTICES | HEADERS | _whole_texts()

_word = re.compile(r"[^\W_]+")
_tag = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9][\w.+-]*\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9][\w.+-]*\)*)*)")


def _cut(text: str) -> list[str]:
    if text.isascii():
        return _word.findall(text.lower())
    return [w.lower() for w in _word.findall(text)]


def _winnowed(numbers: np.ndarray, k: int = K, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Kept k-grams of word numbers and their positions: the smallest mixed value of each run."""
    if len(numbers) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = np.zeros(len(numbers) - k + 1, np.uint64)
    for i in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + numbers[i : len(numbers) - k + 1 + i]
        grams ^= grams >> np.uint64(29)
    views = np.lib.stride_tricks.sliding_window_view(grams, min(run, len(grams)))
    kept = np.zeros(len(grams), bool)
    kept[views.argmin(1) + np.arange(len(views))] = True
    at = np.flatnonzero(kept)
    return grams[at], at


class _Grams:
    """Inverted index of one kind of template: sorted grams, and (template, position) of each."""

    def __init__(self, numbers: dict[str, np.ndarray], k: int, run: int) -> None:
        self.k, self.run = k, run
        self.places: dict[int, list[tuple[str, int]]] = {}
        for name, own in numbers.items():
            for gram, p in zip(*(v.tolist() for v in _winnowed(own, k, run))):
                self.places.setdefault(gram, []).append((name, p))
        self.grams = np.array(sorted(self.places), np.uint64)

    def hits(self, numbers: np.ndarray) -> Iterator[tuple[str, int, int]]:
        """(template, position in the text, position in the template), by position in the text."""
        grams, at = _winnowed(numbers, self.k, self.run)
        if not len(self.grams) or not len(grams):
            return
        near = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        own = self.grams[near] == grams
        for gram, p in zip(grams[own].tolist(), at[own].tolist()):
            for name, q in self.places[gram]:
                yield name, p, q


class Index:
    """Inverted indexes over short and long templates; words of no template share one number."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {name: _cut(text) for name, text in templates.items()}
        every = sorted({w for ws in self.words.values() for w in ws})
        self.number = {w: i + 1 for i, w in enumerate(every)}
        own = {name: self.numbers(ws) for name, ws in self.words.items()}
        self.short = _Grams({n: v for n, v in own.items() if len(v) < LONG}, K, RUN)
        self.long = _Grams({n: v for n, v in own.items() if len(v) >= LONG}, LONG_K, LONG_RUN)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(0)), np.uint64, len(words))


def align(template: list[str], words: list[str], start: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end) of the best in-order match near ``words[start:]`` within the band."""
    width, best = 2 * band + 1, {}
    before = [(0, -1, -1)] * width  # matched, first, end; cell j stands for text position i + start + j - band
    for i, w in enumerate(template):
        row: list[tuple[int, int, int]] = []
        for j in range(width):
            p = start + i + j - band
            skip_template = before[j + 1] if j + 1 < width else (0, -1, -1)
            skip_text = row[j - 1] if j else (0, -1, -1)
            cell = max(skip_template, skip_text, key=lambda c: (c[0], c[1] - c[2]))
            if 0 <= p < len(words) and words[p] == w:
                m, a, _ = before[j]
                cell = max(cell, (m + 1, a if m else p, p + 1), key=lambda c: (c[0], c[1] - c[2]))
            row.append(cell)
        before = row
    best = max(before, key=lambda c: (c[0], c[1] - c[2]))
    return best


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits of ``a``."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        if u:
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _extended(template: list[str], words: list[str], q: int, p: int, step: int) -> tuple[int, int]:
    """(template, text) words by which a match that ends before or begins at (q, p) goes on in a direction.

    A match counts 1 and a skipped or changed word -1; it ends ``DROP`` below the best.
    """
    n = len(template) - q if step > 0 else q
    m = len(words) - p if step > 0 else p
    low = -DROP - 1
    row, best = {0: 0}, (0, 0, 0)  # text words taken: score
    for j in range(1, DROP + 1):
        row[j] = -j
    for i in range(1, n + 1):
        w = template[q + i - 1 if step > 0 else q - i]
        new: dict[int, int] = {}
        for j in range(min(row), min(max(row) + 1, m) + 1):
            score = row.get(j, low) - 1
            if j:
                same = words[p + j - 1 if step > 0 else p - j] == w
                score = max(score, row.get(j - 1, low) + (1 if same else -1), new.get(j - 1, low) - 1)
                if same and score > best[0]:
                    best = (score, i, j)
            if score >= best[0] - DROP:
                new[j] = score
        if not new:
            break
        row = new
    return best[1], best[2]


def _long(words: list[str], index: Index, numbers: np.ndarray, least: float) -> list[tuple[str, int, int, int]]:
    """(template, matched words, first, end) of long templates and parts of them."""
    chains: dict[str, list[list[int]]] = {}  # text and template place of the first and the last hit
    open_: dict[str, list[list[int]]] = {}
    byplace: dict[tuple[str, int], list[int]] = {}
    for name, p, q in index.long.hits(numbers):
        byplace.setdefault((name, p), []).append(q)
    for (name, p), qs in byplace.items():
        own, reach = chains.setdefault(name, []), p - len(index.words[name]) - SLACK
        live = [c for c in open_.get(name, ()) if c[2] >= reach]
        fit = [
            (abs((q - c[3]) - (p - c[2])), -c[2], q, c)
            for c in live
            for q in qs
            if q > c[3] and p - c[2] <= q - c[3] + SLACK
        ]
        if fit:
            _, _, q, c = min(fit, key=lambda f: f[:3])
            c[2:] = [p, q]
        else:
            begun = [[p, q, p, q] for q in qs]
            own += begun
            live += begun
        open_[name] = live
    out = []
    for name, own in chains.items():
        template, found = index.words[name], []
        for p0, q0, p1, q1 in own:
            i, j = _extended(template, words, q0, p0, -1)
            k, h = _extended(template, words, q1 + LONG_K, p1 + LONG_K, 1)
            a, b = p0 - j, p1 + LONG_K + h
            if b - a < min(LEAST_WORDS, least * len(template)):
                continue
            m = common(template[q0 - i : q1 + LONG_K + k], words[a:b])
            if m >= min(LEAST_WORDS, least * len(template)):
                found.append((m, a, b))
        out += [(name, *f) for f in _apart(found)]
    # a part of one text that another text has as well and more of is named for the other only
    return [
        x for x in out
        if x[1] >= least * len(index.words[x[0]]) or not any(
            y[2] <= x[2] and x[3] <= y[3] and y[1] > x[1]
            and common(index.words[y[0]], words[x[2] : x[3]]) >= x[1]
            for y in out if y[0] != x[0]
        )
    ]


def _apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping spans the one with most matched words, then the first."""
    kept: list[tuple[int, int, int]] = []
    for m, a, b in sorted(set(found), key=lambda f: (-f[0], f[1])):
        if not any(x < b and a < y for _, x, y in kept):
            kept.append((m, a, b))
    return kept


def _short(words: list[str], index: Index, numbers: np.ndarray, least: float) -> list[tuple[str, int, int, int]]:
    """(template, matched words, first, end) of short templates."""
    seeds: dict[str, set[int]] = {}
    for name, p, q in index.short.hits(numbers):
        seeds.setdefault(name, set()).add(p - q)
    out = []
    for name, diagonals in seeds.items():
        template, found = index.words[name], []
        kinds, last = set(template), None
        for d in sorted(diagonals):
            if last is not None and d - last <= BAND // 2:
                continue  # the band around ``last`` holds it
            last = d
            near = words[max(d - BAND, 0) : max(d + len(template) + BAND, 0)]
            if len(kinds.intersection(near)) < least * len(template) - len(template) + len(kinds):
                continue  # too few of its words are there at all
            m, a, b = align(template, words, d)
            if m >= least * len(template):
                found.append((m, a, b))
        out += [(name, *f) for f in _apart(found)]
    # versions and kinds differ in a word or two: the template that says more of the same words is meant
    share = {x: (x[1], x[1] / len(index.words[x[0]])) for x in out}
    return [
        x for x in out
        if not any(y[0] != x[0] and y[2] <= x[2] and x[3] <= y[3] and share[y] > share[x] for y in out)
    ]


def matches(text: str | None, index: Index, least: float = LEAST) -> list[tuple[str, int, int, int, float]]:
    """(template, start, end, matched words, coverage) in order; spans in code points, end exclusive.

    Short notices need ``least`` of their words, long templates ``LEAST_WORDS`` words. Of overlapping spans
    of one template the one with most matched words stays, then the first. Each license that an SPDX line
    names is a row of its own, with the span of the line.
    """
    if not text:
        return []
    words = _cut(text)
    numbers = index.numbers(words)
    found = _short(words, index, numbers, least) + _long(words, index, numbers, least)
    places = [m.span() for m in _word.finditer(text)] if found else []
    out = [(name, places[a][0], places[b - 1][1], m, m / len(index.words[name])) for name, m, a, b in found]
    if "SPDX-License-Identifier:" in text:
        for m in _tag.finditer(text):
            named = re.split(r"\s+(?:AND|OR|WITH)\s+|[()\s]+", m[1])
            for name in dict.fromkeys(n for n in named if n):
                out.append((f"spdx:{name}", m.start(), m.end(), len(_word.findall(m[0])), 1.0))
    return sorted(out, key=lambda r: (r[1], r[0]))


def notices(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    least: float = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per notice: doc_id, template, span_start, span_end, matched_words, coverage.

    Null and empty texts have none; repeated rows each report theirs; other columns are ignored.
    """
    chosen = dict(TEMPLATES if templates is None else templates)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen)
        for batch in parts:
            rows = [
                (doc, *m)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for m in matches(text, index, least)
            ]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "template", "span_start", "span_end", "matched_words", "coverage"],
            )

    return texts(docs, id_col, text_col).mapInArrow(
        scan,
        "doc_id long, template string, span_start long, span_end long, matched_words long, coverage double",
    )
