"""Fill-in-middle texts and the wavelet matrix below them, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from cohortloom.llm import infill
from cohortloom.llm.wavelet import WaveletMatrix

SCHEMA = "doc_id long, text string, n long, output string"


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000])
def test_ranks_and_selects(size):
    draw = np.random.default_rng(size)
    symbols = draw.integers(0, 6, size).astype(np.uint8)
    matrix = WaveletMatrix(symbols, 3)
    at = np.arange(size + 1)
    for s in range(8):
        counts = np.concatenate([[0], np.cumsum(symbols == s)])
        assert (matrix.rank(s, at) == counts).all()
    both = np.flatnonzero(np.isin(symbols, [1, 4])) + 1
    if len(both):
        k = np.arange(1, len(both) + 1)
        ends = np.zeros(len(k), np.int64), np.full(len(k), size)
        assert (matrix.select((1, 4), k, *ends) == both).all()


UNITS = {
    "line": r"[^\n]*\n|[^\n]+",
    "word": r"\A\s*\S+\s*|\S+\s*",
    "sentence": r"(?s:.*?(?:\n|(?<=\S)[.!?](?=\s|\Z)))|(?s:.+)",
}


@pytest.mark.parametrize("unit", UNITS)
def test_cuts_of_every_unit(unit):
    draw = random.Random(3)
    texts = ["", "\n", "a", "a\n", "\n\na", "ß😀. x!\ny", "one two.  three\tfour", "a\r\nb c\n"]
    texts += ["".join(draw.choice("ab é😀.!\n\t ") for _ in range(draw.randrange(80))) for _ in range(200)]
    if unit == "word":
        texts = [t for t in texts if not t or t.strip()]
    if unit == "sentence":  # a blank before a mark leaves it inside
        texts = [re.sub(r"\s+([.!?])", r"\1", t) for t in texts]
        texts = [re.sub(r"^[.!?]+", "", t) for t in texts]
    bounds = infill.Boundaries(texts, unit)
    for i, text in enumerate(texts):
        units = re.findall(UNITS[unit], text)
        assert "".join(units) == text
        assert bounds.n[i] == len(units), (text, units)
    for k in range(12):
        wanted = np.minimum(k, bounds.n)
        for text, j, got in zip(texts, wanted, bounds.cut(wanted)):
            assert got == len("".join(re.findall(UNITS[unit], text)[:j])), (text, j)


def expected(doc, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        form, out, sizes = "plain", text, (None, None)
    elif h4 % 100 < 50:
        form, out, sizes = "spm", f"<S>{s}<P>{p}<M>{m}", (len(p), len(m))
    else:
        form, out, sizes = "psm", f"<P>{p}<S>{s}<M>{m}", (len(p), len(m))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (n, form, *sizes, sha(out), sha(text))


def test_digests(rows):
    draw = random.Random(8)
    data = [(1, None), (2, ""), (3, "\n"), (4, "has <S> inside\nand more"), (5, "İ😀\r\n日本\n\n"), (None, "a\nb"),
            (6, "<P\n>x<\nS>\n<"), (7, "line\n" * 30_000), (8, "x" * 200_000), (9, "tie\ntie"), (9, "tie\ntie")]
    data += [(i, "".join(draw.choice("ab <>PSM\n") for _ in range(draw.randrange(60)))) for i in range(20, 160)]
    got = infill.digests(rows([(i, t, 1, "clash") for i, t in data], SCHEMA)).collect()
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    want = [(doc, *expected(doc, text)) for doc, text in data]
    assert sorted([tuple(r[c] for c in names) for r in got], key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_rate_seed_and_text_ids(rows):
    table = rows([(f"doc-{i}", f"one two\nthree {i}\n") for i in range(200)], "name string, body string")
    made = infill.infilled(table, unit="word", seed=3, rate=30, spm=0, id_col="name", text_col="body").collect()
    forms = [r["form"] for r in made]
    assert 30 < forms.count("psm") < 90 and "spm" not in forms
    assert made[0]["doc_id"].startswith("doc-")
    with pytest.raises(ValueError):
        infill.infilled(table, unit="page", id_col="name", text_col="body")


def test_no_rows(rows):
    assert infill.digests(rows([], SCHEMA)).count() == 0
