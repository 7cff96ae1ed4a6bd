"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortloom.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, form string"


def one_edit(a, b):
    """One inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def near_by_hand(count):
    return {w: [x for x in count if one_edit(w, x)] for w in count}


def made_words(draw, number, letters="abé", low=1, high=9):
    return sorted({"".join(draw.choice(letters) for _ in range(draw.randrange(low, high))) for _ in range(number)})


@pytest.mark.parametrize("seed", range(12))
def test_scan_of_one_group_finds_every_pair_once(seed):
    draw = random.Random(seed)
    words = made_words(draw, 120)
    for size in range(1, 9):
        some = [w for w in words if len(w) in (size, size + 1)]
        if not some:
            continue
        for low, high in ((0, size // 2), (size // 2, size + 1), (0, size + 1)):
            ends = [np.full(len(some), x) for x in (size, low, high)]
            # all words in one group, whatever they share: the range of places alone decides
            a, b = spelling.near_pairs(some, np.zeros(len(some), np.int64), *ends)
            got = sorted((some[x], some[y]) for x, y in zip(a, b))
            want = []
            for x in some:
                for y in some:
                    common = next((i for i, c in enumerate(x) if i >= len(y) or c != y[i]), len(x))
                    if len(x) == size and one_edit(x, y) and low <= common < high:
                        want.append((x, y))
            assert got == sorted(want)


def by_hand(words):
    near = near_by_hand(words)
    best = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    return {w: (len(near[w]), best[w], words[best[w]] if near[w] else None) for w in words}


@pytest.mark.parametrize("group_words", [3, 40, 50_000])
def test_near_words_with_groups_split(rows, group_words, monkeypatch):
    monkeypatch.setattr(spelling, "SCAN_WORDS", 500)
    draw = random.Random(group_words)
    words = {w: draw.randrange(1, 6) for w in made_words(draw, 700, "abcé", 1, 8)}
    words |= {"z" * 3000: 5, "z" * 2999 + "y": 7, "z" * 3001: 7}
    table = rows(list(words.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["near"], r["near_n"]) for r in spelling.near_words(table, group_words).collect()}
    want = by_hand(words)
    assert got == {w: x for w, x in want.items() if x[0]}


def by_definition(data):
    count = Counter()
    for doc, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    out, found = {}, by_hand(words)
    for w, n in words.items():
        n_near, near, near_n = found[w]
        formed = bool(n_near) and near_n >= 10 * n
        out[w] = [near if formed else None, None, n, n_near, near_n if formed else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def columns(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants(rows):
    draw = random.Random(5)
    stems = ["spelling", "ÉCOLIÈRES", "Variants", "grouping", "überaus", "x" * 50, "short", "tiesone", "tiestwo"]
    data = [(1, None), (2, ""), (3, "spellingſ K tiesone,tiestwo"), (None, "spelling variants"), (4, "é" * 40_000)]
    for i in range(10, 130):
        words = [draw.choice(stems) for _ in range(draw.randrange(400))]
        for j in range(len(words)):
            if draw.random() < 0.03:
                at = draw.randrange(len(words[j]))
                words[j] = words[j][:at] + draw.choice(["", "q", "é" + words[j][at]]) + words[j][at + 1 :]
        data.append((i, draw.choice([" ", "\n", "-", "1"]).join(words)))
    # a chain of forms of three steps
    chain = ["chainaaaa"] * 3 + ["chainaaab"] * 40 + ["chainaabb"] * 500 + ["chainabbb"] * 6000
    data += [(200, " ".join(chain)), (200, " ".join(chain))]
    got = columns(spelling.variants(rows([(i, t, "clash", 1, "x") for i, t in data], SCHEMA)))
    want = by_definition(data)
    assert got == want
    assert want["chainaaaa"][1] == "chainabbb" and sum(x[0] is not None for x in want.values()) > 20


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = columns(spelling.variants(docs))
    assert got == by_definition([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_no_words(rows):
    assert spelling.variants(rows([], SCHEMA)).count() == 0
    assert spelling.variants(rows([(1, None, "", 1, ""), (2, "a few short ones", "", 1, "")], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(rows([], SCHEMA), ratio=1)
