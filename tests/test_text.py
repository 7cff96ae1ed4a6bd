import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.functions import codes as cd
from cohortloom.functions import numbers as nm
from cohortloom.functions import text as tx
from cohortloom.operators import features as fx


def one(spark, values, make, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}").coalesce(1)
    return [r.y for r in df.select(make(F.col("x")).alias("y")).collect()]


def py_clean(text):
    if text is None:
        return ""
    return re.sub(r"\s+", " ", re.sub(r"_{2,}", " [REDACTED] ", text)).strip()


def py_words(text):
    low = unicodedata.normalize("NFKD", (text or "").lower())
    return re.findall(r"\b\w\w+\b", "".join(c for c in low if not unicodedata.combining(c)))


TEXTS = [
    "Patient is    Mr. ___   admitted on ___   with    CHF.", "", None, "hello world test",
    "a b\x1cc\x85d e\n\tf", "__ _ ___", "  ", "Café naïve ﬁnal ǆ x2 \U0001f600 ok", "ÉÈ ß œuvre",
]


def test_clean_text(spark):
    got = one(spark, TEXTS, tx.clean_text)
    assert got == [py_clean(t) for t in TEXTS]
    assert "[REDACTED]" in got[0] and "  " not in got[0]


def test_token_length(spark):
    assert one(spark, ["hello world test", "", None], tx.token_length) == [3, 0, 0]
    assert one(spark, TEXTS, tx.token_length) == [len((t or "").split()) for t in TEXTS]
    cleaned = one(spark, TEXTS, lambda c: tx.clean_token_length(tx.clean_text(c)))
    assert cleaned == [len(py_clean(t).split()) for t in TEXTS]


def test_words_match_the_unicode_definition(spark):
    assert one(spark, TEXTS, tx.tokenize_words) == [py_words(t) for t in TEXTS]


def test_words_of_every_character(spark):
    assigned = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    # marks of one word each: folding must not depend on the neighbours
    texts = ["".join(f"x{c}y " for c in assigned[i : i + 500]) for i in range(0, len(assigned), 500)]

    def folded(text):
        low = unicodedata.normalize("NFKD", text)
        return "".join(c for c in low if not unicodedata.combining(c))

    got = one(spark, texts, tx.fold_accents)
    wrong = [(t, g) for t, g in zip(texts, got) if g != folded(t)]
    assert not wrong, [(a, b) for t, g in wrong[:1] for a, b in zip(folded(t).split(" "), g.split(" ")) if a != b][:5]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60), min_size=1, max_size=8))
def test_text_properties(spark, texts):
    texts = [t.replace("\x00", "") for t in texts]
    assert one(spark, texts, tx.clean_text) == [py_clean(t) for t in texts]
    assert one(spark, texts, tx.token_length) == [len(t.split()) for t in texts]
    assert one(spark, texts, tx.count_deid_markers) == [len(re.findall("_{2,}", t)) for t in texts]


def test_redacted_context_counts_code_points(spark):
    text = "\U0001f600" * 50 + " MRN: 77 " + "z" * 60
    pattern = r"(?iU)\bMRN\s*[:#]"
    got = one(spark, [text], lambda c: tx.redacted_context(
        c, tx.match_start(c, pattern), F.length(F.regexp_substr(c, F.lit(pattern)))))[0]
    m = re.search(r"\bMRN\s*[:#]", text)
    assert got == f"...{text[m.start() - 40:m.start()]}[REDACTED]{text[m.end():m.end() + 40]}..."


def test_codes(spark):
    raw = ["E785", "I4891", "Z20822", "I10", "F32", ""]
    assert one(spark, raw, cd.format_code) == ["E78.5", "I48.91", "Z20.822", "I10", "F32", ""]
    assert one(spark, [" e785 ", "\ti10\n"], cd.normalize_code) == ["E785", "I10"]
    padded = [f"{c} x{c}1{c}{c}" for c in tx.SPACE_CHARS]
    assert one(spark, padded, cd.normalize_code) == [p.strip().upper() for p in padded]


def test_numbers(spark):
    ages = [0, 17, 18, 84, 85, 199, 200, -1, None]
    want = ["<18", "<18", "18-29", "75-84", "85+", "85+", None, None, None]
    assert one(spark, ages, nm.age_bucket, "int") == want
    assert one(spark, ["1", "x", None, "2.5"], nm.numeric_coerce) == [1.0, 0.0, 0.0, 2.5]
    assert one(spark, ["2020-01-01", "nope", None], nm.year_of) == [2020, None, None]
    assert one(spark, [50, 3, None], lambda c: nm.clip_upper(c, 40), "int") == [40, 3, None]
    years = one(spark, ["2014 - 2016"], lambda c: nm.real_year_approx(
        F.lit("2152-03-01").cast("timestamp"), F.lit(2150), c))
    assert years == [2017.0]


def test_document_terms_brute_force(spark):
    texts = [(1, "red fish blue fish red fish"), (2, ""), (3, "one"), (4, None), (5, "aa aa aa aa")]
    df = spark.createDataFrame(texts, "hadm_id long, text string")
    got = {r.hadm_id: {t.term: t.tf for t in r.terms} for r in fx.document_terms(df).collect()}
    for key, text in texts:
        words = py_words(text)
        grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        assert got[key] == {g: grams.count(g) for g in grams}


@pytest.mark.parametrize("low,high", [(1, 1), (1, 3), (2, 2)])
def test_ngrams(spark, low, high):
    words = ["aa", "bb", "cc", "dd"]
    df = spark.createDataFrame([(words,), (["aa"],)], "w array<string>").coalesce(1)
    got = [r.g for r in df.select(tx.word_ngrams(F.col("w"), low, high).alias("g")).collect()]
    want = [" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]
    assert got[0] == want
    assert got[1] == (["aa"] if low == 1 else [])


def test_words_and_terms_are_one_pass_of_arrow(spark):
    texts = [(1, "Cafe\u0301 au lait Caf\u00e9"), (2, None), (3, ""), (4, "x"), (5, "\u0e33\u0327 \u1e9b\u0323 na\u00efve " * 3), (6, "aa  bb")]
    df = spark.createDataFrame(texts * 60, "hadm_id long, text string").coalesce(1)
    found = fx.document_terms(df)
    plan = found._jdf.queryExecution().toString()
    # neither a regular expression nor a lambda per item is left to rows
    assert "ArrowEvalPython" in plan and "regexp" not in plan and "lambda" not in plan
    for row in found.collect():
        words = py_words(dict(texts)[row.hadm_id])
        grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        assert [tuple(t) for t in row.terms] == sorted((g, grams.count(g)) for g in set(grams))


def test_counts_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    lists = pa.array([["b", "a", "b"], [], None, ["c"] * 5, ["a"]])
    want = [[{"term": "a", "tf": 1}, {"term": "b", "tf": 2}], [], [], [{"term": "c", "tf": 5}], [{"term": "a", "tf": 1}]]
    assert fx._counted(lists).to_pylist() == want
    monkeypatch.setattr(fx, "WEIGHED_TERMS", 2)
    assert fx._counted(lists).to_pylist() == want
    assert fx._counted(lists.slice(3)).to_pylist() == want[3:]
    assert tx._ngrams(lists.slice(3), 1, 2).to_pylist() == [["c"] * 5 + ["c c"] * 4, ["a"]]


def test_vectors_are_assembled_by_batches(spark):
    cells = "array<struct<term_idx:int,weight:double>>"
    data = [(1, [(0, 0.5), (3, 0.25)]), (2, []), (3, [(6, 1.0)])] * 20
    df = spark.createDataFrame(data, f"hadm_id long, features {cells}").coalesce(1)
    made = fx.assemble_sparse_vectors(df, 7)
    assert "ArrowEvalPython" in made._jdf.queryExecution().toString()
    got = {r.hadm_id: r.features for r in made.collect()}
    assert {k: (v.size, dict(zip(v.indices.tolist(), v.values.tolist()))) for k, v in got.items()} == {
        1: (7, {0: 0.5, 3: 0.25}), 2: (7, {}), 3: (7, {6: 1.0}),
    }
    for wrong in ([(7, 1.0)], [(3, 1.0), (2, 1.0)]):
        with pytest.raises(Exception, match="feature"):
            fx.assemble_sparse_vectors(spark.createDataFrame([(1, wrong)], df.schema), 7).collect()


def test_terms_of_long_texts_are_cut_in_pieces(spark):
    import pyarrow as pa

    from cohortloom import session

    words = " ".join(f"w{i}" for i in range(2_000))
    found = fx.document_terms(spark.createDataFrame([(0, "aa bb")], "hadm_id long, text string"))
    _, (step,) = session._steps[found]
    batch = pa.RecordBatch.from_pydict({"hadm_id": list(range(300)), "text": [words] * 300})
    made = list(step(iter([batch])))
    assert [k for b in made for k in b.column(0).to_pylist()] == list(range(300))
    # a text is 10,890 bytes and 3,999 terms; terms of a whole batch used to be held together
    assert max(b.num_rows for b in made) <= fx.CUT_BYTES // 10_000 and {len(t) for b in made for t in b.column(1)} == {3_999}


@pytest.mark.parametrize("merged", [1, 7, 300_000])
def test_vocabulary_of_texts_is_that_of_written_terms(spark, monkeypatch, merged):
    from cohortloom.session import cut_lineage

    monkeypatch.setattr(fx, "CUT_BYTES", 20)
    monkeypatch.setattr(fx, "MERGED_TERMS", merged)
    texts = [(1, "red fish blue fish red fish"), (1, ""), (2, None), (None, "red cod"), (4, "x"), (5, "café cod cafe")]
    terms = fx.document_terms(spark.createDataFrame(texts, "hadm_id long, text string").coalesce(1))
    plan = fx._uses(terms)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "ArrowEvalPython" not in plan
    counts = {}
    for _, text in texts:
        words = py_words(text)
        grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        for g in set(grams):
            tf, df = counts.get(g, (0, 0))
            counts[g] = tf + grams.count(g), df + 1
    kept = sorted(sorted((g for g in counts if counts[g][1] >= 1), key=lambda g: (-counts[g][0], g))[:6])
    for source in (terms, cut_lineage(terms, "terms")):
        got = fx.vocabulary(source, 1, 6).orderBy("term_idx").collect()
        assert [tuple(r) for r in got] == [(i, g, *counts[g]) for i, g in enumerate(kept)]
