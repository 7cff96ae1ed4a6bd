"""The operators of the subpackage against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortloom.llm import bitplanes, decontaminate, hnsw, jaccard, licenses, packing, pii, quality, repeats, trie_lm

SCHEMA = "doc_id long, text string, item_id string, n long"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


@pytest.fixture(scope="module")
def docs(rows):
    draw = random.Random(4)
    data = [(1, None), (2, ""), (3, " \n"), (4, "ab"), (5, "İé 日本 \U0001f600 text"), (None, "null id text")]
    for i in range(6, 40):
        data.append((i, " ".join(draw.choice(BASE) for _ in range(draw.randrange(1, 90)))))
    data += [(40, data[20][1]), (41, data[20][1] + " omega"), (42, " ".join(BASE * 300)), (43, "x" * 70_000)]
    return rows([(i, t, "clash", 1) for i, t in data], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def text_of(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_decontamination(docs, rows):
    bench = rows([(1, " ".join(BASE[:14])), (2, "Pi, rho!"), (3, None), (10, "---")], "item_id long, text string")
    got = by_id(decontaminate.contamination(docs, bench))
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower() if t.isascii() else t)
    wins = [(1, tuple(BASE[i : i + 10])) for i in range(5)] + [(2, ("pi", "rho"))]
    for doc, text in text_of(docs).items():
        w, hit, items = cut(text), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    items.add(str(item))
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        row = got[doc]
        assert (row["n_words"], row["n_hit"], row["n_items"], row["items_sha256"]) == (len(w), len(hit), len(items), digest)
        assert row["contaminated"] == bool(hit)
    kept = decontaminate.clean(docs.withColumnRenamed("n", "key"), bench)
    assert kept.columns == ["doc_id", "text", "item_id", "key"]
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if not r["contaminated"]}


def test_decontamination_of_text_ids_repeats_and_long_texts(rows):
    text = " ".join(BASE)
    docs = rows([("b", text), ("b", text), ("c", f"{text} " * 3_000 + "omega"), (None, text), ("d", text[:20])],
                "doc_id string, text string")
    bench = rows([("x", text[3:70]), ("x", "Omega"), (None, text[40:]), ("x", text[3:70])], "item_id string, text string")
    got = decontaminate.contamination(docs, bench).collect()
    both = hashlib.sha256(b"null,x").hexdigest()
    assert sorted((r["doc_id"] or "", r["n_items"], r["items_sha256"] == both) for r in got) == [
        ("", 2, True), ("b", 2, True), ("b", 2, True), ("c", 2, True), ("d", 0, False)
    ]
    assert next(r["n_words"] for r in got if r["doc_id"] == "c") == len(BASE) * 3_000 + 1
    assert decontaminate.clean(docs, rows([], "item_id long, text string")).count() == 5


def test_nearest(rows):
    r = np.random.default_rng(0)
    v = r.normal(size=(300, 8)).astype(np.float32)
    v[50:120] = v[50]
    data = [(i, v[i].tolist()) for i in range(300)] + [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8)]
    got = hnsw.nearest(rows(data, "vec_id long, embedding array<float>"), shard_rows=100).toPandas()
    w = v.astype(float)
    hits = 0
    for q in range(0, 300, 20):
        s = (w * w[q]).sum(1)
        s[q] = -np.inf
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own["score"], s[own["vec_id"]], atol=1e-12)
        hits += len(set(own["vec_id"]) & set(np.lexsort((np.arange(300), -s))[:20]))
    assert hits >= 0.9 * 15 * 20 and got["query_id"].nunique() == 15


@pytest.mark.parametrize("seed", range(30))
def test_packing_plan(seed):
    draw = random.Random(seed)
    cap = draw.choice([8, 16, 64])
    counts = {draw.randrange(1, cap): draw.randrange(1, 40) for _ in range(draw.randrange(0, cap))}
    placed, n = packing.plan(counts, cap)
    parts, seqs = {}, {}
    for length, a, b, start, size, seq, offset in placed:
        for rank in range(a, b):
            parts.setdefault((length, rank), []).append((start, size))
            seqs.setdefault(seq + rank - a, []).append((offset, size))
    assert sorted(seqs) == list(range(n))
    assert set(parts) == {(x, r) for x, c in counts.items() for r in range(c)}
    for (length, _), own in parts.items():
        assert [s for s, _ in sorted(own)] == list(np.cumsum([0, *[z for _, z in sorted(own)]])[:-1])
        assert sum(z for _, z in own) == length
    for own in seqs.values():
        assert [o for o, _ in sorted(own)] == list(np.cumsum([0, *[z for _, z in sorted(own)]])[:-1])
        assert sum(z for _, z in own) <= cap
    assert n * cap - sum(x * c for x, c in counts.items()) < 2 * cap


def encoded(text, end):
    from cohortloom.llm.token_ids import TokenIds, default_vocabulary

    full = TokenIds.of(default_vocabulary()).full
    return np.array([*full.encode(text, add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_every_character(name):
    import public_tokenizers

    from cohortloom.llm.token_ids import TokenIds

    coder = TokenIds.of(public_tokenizers.path(name))
    chars = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA0, 0x250), *range(0x2010, 0x2028)]]
    texts = [t for c in chars for t in (f"ab{c}cd 1{c}2", f"{c}{c} x.{c}'{c}s", c)] + ["Azərbaycan Ə <|endoftext|>", "İI"]
    ids, sizes = coder.encode(texts)
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends):
        assert ids[a:b].tolist() == coder.full.encode(text, add_special_tokens=False).ids, text


def test_known_words_stay_when_the_cache_is_full(monkeypatch):
    from cohortloom.llm import token_ids

    monkeypatch.setattr(token_ids, "CACHE_WORDS", 30)
    coder, learned = token_ids.TokenIds(token_ids.default_vocabulary()), []
    learn = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda words: (learned.append(len(words)), learn(words))[1])
    old, new = [f"quixotic{x}" for x in BASE], [f"wörld{x}" for x in BASE[:15]]
    for text in (" ".join(old), " ".join([*old, *new])):
        ids, sizes = coder.encode([text, "", None])
        assert ids.tolist() == coder.full.encode(text, add_special_tokens=False).ids and sizes.tolist() == [len(ids), 0, 0]
    assert learned == [len(old), len(new)]


def test_pieces_hold_every_id(docs):
    got = packing.pieces(docs, capacity=256).toPandas().sort_values(["doc_id", "start"])
    for doc, text in text_of(docs).items():
        own = got[got["doc_id"].isna() if doc is None else got["doc_id"] == doc]
        assert b"".join(own["ids"]) == encoded(text, 1).tobytes()
    filled = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")["length"]
    assert filled.sum().max() <= 256


def test_token_files(docs):
    ids = np.random.default_rng(1).integers(0, 2**32, 150_001, dtype=np.uint32)
    image = bitplanes.pack_ids(ids)
    assert (bitplanes.unpack_ids(image) == ids).all()
    assert (bitplanes.unpack_ids(image, 65_530, 20) == ids[65_530:65_550]).all()
    assert len(bitplanes.unpack_ids(bitplanes.pack_ids(ids[:0]))) == 0
    got, texts, start = by_id(bitplanes.round_trip(docs)), text_of(docs), 0
    for doc in sorted(texts, key=lambda d: -1 if d is None else d):
        own = encoded(texts[doc], 2)
        row = got[doc]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)


def test_licenses():
    index = licenses.Index(licenses.TEMPLATES)
    text = "Bla bla.\nThis work is licensed under the GNU General Public License, version 3. Released under the MIT license"
    assert [(m[0], text[m[1] : m[2]], m[4]) for m in licenses.matches(text, index)] == [
        ("gpl-3.0", text[9:78], 1.0), ("mit", text[80:], 1.0)
    ]
    assert licenses.matches(None, index) == licenses.matches("the version of this work", index) == []


def test_whole_edited_and_partial_licenses():
    index = licenses.Index(licenses.TEMPLATES)
    draw = random.Random(1)
    around = " ".join(draw.choice(BASE) for _ in range(300))
    named = lambda text: {m[0]: m for m in licenses.matches(text, index)}
    for name in ("mit", "isc", "bsd-3-clause", "apache-2.0", "lgpl-2.1", "gpl-3.0", "mpl-2.0", "cc-by-sa-3.0"):
        whole = licenses.TEMPLATES[name + "-text"].strip()
        words = len(index.words[name + "-text"])
        text = f"{around} {whole} {around} {whole}"
        spans = [m[1:] for m in licenses.matches(text, index) if m[0] == name + "-text"]
        assert [(m[2], m[3]) for m in spans] == [(words, 1.0)] * 2
        assert all(licenses._cut(text[a:b]) == index.words[name + "-text"] for a, b, _, _ in spans)
        cells = whole.split()
        edited = " ".join(c if i % 9 else "edited" for i, c in enumerate(cells))
        assert 0.75 < named(f"{around} {edited} {around}")[name + "-text"][4] < 0.95
        half = named(f"{around} {' '.join(cells[: len(cells) // 2])} {around}")[name + "-text"]
        assert 0.3 < half[4] < 0.7 and abs(half[1] - len(around) - 1) < 12


def test_license_headers_kinds_and_tags():
    index = licenses.Index(licenses.TEMPLATES)
    names = lambda text: [m[0] for m in licenses.matches(text, index)]
    for name, header in licenses.HEADERS.items():
        assert name in names(f"/* {header} */ int main")
    assert names("Licensed under CC BY-SA 4.0.") == ["cc-by-sa-4.0"]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["gpl-2.0"]
    assert names("This work is licensed under the GNU Lesser General Public License, version 3.") == ["lgpl-3.0"]
    text = "// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint x;"
    assert [(m[0], text[m[1] : m[2]]) for m in licenses.matches(text, index)] == [
        ("spdx:Apache-2.0", text[3:47]), ("spdx:MIT", text[3:47])
    ]


def test_repeats(docs):
    got, texts = by_id(repeats.without_repeats(docs)), text_of(docs)
    first = {}
    for doc in sorted(d for d in texts if d is not None):
        data = texts[doc].encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if first.setdefault(data[i : i + 50], doc) < doc:
                gone[i : i + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()
        row = got[doc]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) == (len(data), gone.sum(), runs, kept)


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_components(docs, size, percent):
    got, texts = by_id(jaccard.linked(docs, size, percent)), text_of(docs)
    sets = {}
    for doc, text in texts.items():
        w = [x for x in re.split("[ \t-\r]+", text.lower() if text.isascii() else text) if x]
        sets[doc] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    ids = sorted(d for d in sets if d is not None)
    root = {d: d for d in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if all(root[root[d]] == root[d] for d in ids):
            break
    assert {d: (got[d]["n_shingles"], got[d]["component_id"]) for d in ids} == {d: (len(sets[d]), root[d]) for d in ids}


def test_links_survive_hot_tokens(rows, monkeypatch):
    # a passage that all texts hold, a group of texts with own noise below the threshold, and chains above it
    monkeypatch.setattr(jaccard, "LATE_TOKENS", 50)
    draw = random.Random(9)
    fresh = lambda n: " ".join(f"w{draw.randrange(10**9)}" for _ in range(n))
    passage, base = fresh(40), fresh(200)
    data = [f"{fresh(60)} {passage} {fresh(60)}" for _ in range(40)]
    data += [f"{base} {fresh(draw.choice([8, 14, 30]))}" for _ in range(60)]
    for _ in range(12):
        text = fresh(120).split()
        for _ in range(5):
            text[draw.randrange(120)] = fresh(1)
            data.append(" ".join(text))
    got = by_id(jaccard.linked(rows([(i, t, "", 1) for i, t in enumerate(data)], SCHEMA), 3, 90))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in data]
    root = list(range(len(data)))
    for _ in range(6):
        for a in range(len(data)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
    assert [got[i]["component_id"] for i in range(len(data))] == root and len(set(root)) < len(data) - 20


def test_pairs_beyond_the_similarity_are_not_written(rows, monkeypatch):
    # texts of one origin, all pairs of them somewhat below the threshold, and two that link
    draw, written, cut = random.Random(3), Counter(), jaccard.cut_lineage
    fresh = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    base, data = fresh(200), []
    for _ in range(60):
        data.append(" ".join(base[:150] + fresh(20) + base[150:]))
    data.append(data[0] + " end")

    def counted(df, label):
        table = cut(df, label)
        written[label] += table.count()
        return table

    monkeypatch.setattr(jaccard, "cut_lineage", counted)
    got = by_id(jaccard.linked(rows([(i, t, "", 1) for i, t in enumerate(data)], SCHEMA), 3, 90))
    assert [got[i]["component_id"] for i in range(61)] == [*range(60), 0]
    assert 1 <= written["pairs"] < 61


def test_sketches_differ_by_no_more_than_sets():
    draw = np.random.default_rng(2)
    many = draw.integers(0, 2**63, 3_000).astype(np.uint64)
    sets = [np.unique(draw.choice(many, n)) for n in (0, 1, 5, 40, 300, 2_900, 3_000)]
    bits = np.unpackbits(jaccard.sketches(sets).view(np.uint8), axis=1)
    for a in range(len(sets)):
        for b in range(len(sets)):
            assert (bits[a] != bits[b]).sum() <= len(np.setxor1d(sets[a], sets[b]))
    assert bits[3].sum() >= 30


def test_language_model(docs):
    got, texts = by_id(trie_lm.scores(docs)), text_of(docs)
    cut = {d: [x for x in re.split("[ \t-\r]+", t.lower() if t.isascii() else t) if x] + [0] for d, t in texts.items()}
    out = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in cut}
    ones = Counter(x for d, w in cut.items() if not out[d] for x in w)
    total, kinds = sum(ones.values()), len(ones)
    for doc, w in cut.items():
        row = got[doc]
        base = sum(np.log10((ones[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(w), sum(ones[x] > 0 for x in w), total)
        assert row["held_out"] == out[doc] and abs(row["base_score"] - base) < 1e-6 and row["score"] < 0


def test_patterns_and_masking(rows):
    text = "Mail a.b@c.org now, ip 10.0.0.256 or 10.0.0.25, card 4111 1111 1111 1111, call +49 (30) 1234567."
    kinds = [(pii.KINDS[k], text[a:b]) for a, b, k in pii.base_spans(text)]
    assert kinds == [("email", "a.b@c.org"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234567")]
    table = rows([(i, text, "x", 1) for i in range(30)] + [(98, None, "x", 1), (99, "clean words", "x", 1)], SCHEMA)
    got = by_id(pii.scan(table))
    assert [got[0][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    assert got[98]["spans"] == got[99]["spans"] == ""
    masked = by_id(pii.mask(table))
    assert "a.b@c.org" not in masked[0]["text"] and masked[99]["text"] == "clean words" and masked[98]["text"] is None


@pytest.fixture(scope="module")
def tagger():
    return pii._model(pii.fitted(pii.made(1_200, 11)))


def tagged(tagger, values):
    bases = [pii.base_spans(t) for t in values]
    return [pii.all_spans(t, b, a) for t, b, a in zip(values, bases, pii.decoded(tagger, values, bases))]


def test_held_out_recall(tagger):
    held = pii.made(1_500, 99)
    hit, every, wrong = Counter(), Counter(), 0
    for (text, want), got in zip(held, tagged(tagger, [t for t, _ in held])):
        for span in want:
            every[span[2]] += 1
            hit[span[2]] += any(a <= span[0] and span[1] <= b for a, b, _ in got)
        wrong += not want and bool(got)
    assert all(hit[k] >= 0.75 * every[k] for k in range(4)), (hit, every)
    assert wrong <= 0.1 * sum(not want for _, want in held)


def test_obfuscated_spans_are_whole(tagger):
    far = "word " * 400
    mails = ["some.long.first.and.last.name.of.a.person @ host.org", "maria at example dot org", "maria (at) example.org"]
    for mail in mails:
        text = f"{far}please write to {mail}, thanks. {far}"
        at = text.index(mail)
        assert tagged(tagger, [text])[0] == [(at, at + len(mail), 0)]
    assert tagged(tagger, [far + "met @ noon. It rained at ten."]) == [[]]


def test_regions_hold_every_plausible_span():
    draw, text = random.Random(6), []
    for sentence, _ in pii.made(400, 5):
        text.append(sentence + " " + "filler words " * draw.randrange(0, 30))
    text = " ".join(text) + " 555 1234" * 500
    pieces = pii.regions(text, [])
    forms = [(m.start(), m.end()) for m in pii._MAIL.finditer(text) if m.end() - m.start() <= pii.MAX_SPAN]
    forms += [m.span() for m in pii._PHONE_FORM.finditer(text) if pii._plausible(m[0], 3)]
    assert len(forms) > 100 and all(any(a <= x and y <= b for a, b in pieces) for x, y in forms)


def test_quality(rows):
    draw = random.Random(2)
    make = lambda extra: " ".join(draw.choice(BASE) for _ in range(30)) + extra
    data = [(i, make(["", " @@@ junk", " idiot"][i % 3]), "x", 1) for i in range(300)] + [(999, None, "x", 1)]
    labels = rows([(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(240)], "doc_id long, quality int, toxic int")
    got = by_id(quality.ratings(rows(data, SCHEMA), labels))
    assert all(got[i]["keep"] == (i % 3 == 0) for i in range(300)) and 999 in got
    assert quality.select_good(rows(data, SCHEMA), labels).columns == ["doc_id", "text", "item_id", "n"]


def test_empty_tables(rows):
    none = rows([], SCHEMA)
    bench = rows([], "item_id long, text string")
    labels = rows([], "doc_id long, quality int, toxic int")
    for made in (
        decontaminate.contamination(none, bench), packing.pieces(none), bitplanes.round_trip(none),
        licenses.notices(none), repeats.without_repeats(none), jaccard.linked(none), trie_lm.scores(none),
        pii.scan(none), quality.ratings(none, labels), hnsw.nearest(rows([], "vec_id long, embedding array<float>")),
    ):
        assert made.count() == 0


def test_language_model_knows_only_ascii_letters_and_spaces(rows):
    held, kept = (next(d for d in range(99) if (zlib.crc32(str(d).encode()) % 5 == 1) == out) for out in (True, False))
    texts = {kept: "É B É b İ K\x1cK K x\x85y", held: "é b É b k\x1ck K x\x85y x y"}
    got = by_id(trie_lm.scores(rows([(d, t, "x", 1) for d, t in texts.items()], SCHEMA)))
    cut = lambda t: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [0]
    ones = Counter(cut(texts[kept]))
    total, kinds = sum(ones.values()), len(ones)
    for doc, text in texts.items():
        w, row = cut(text), got[doc]
        base = sum(np.log10((ones[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(w), sum(ones[x] > 0 for x in w), total)
        assert row["held_out"] == (doc == held) and abs(row["base_score"] - base) < 1e-9


@pytest.mark.parametrize(("order", "slices"), [(2, False), (3, False), (3, True), (4, True)])
def test_language_model_of_any_order_by_the_formula(rows, monkeypatch, order, slices):
    if slices:  # frequent pairs in several shards
        monkeypatch.setattr(trie_lm, "SLICE_GRAMS", 20)
        monkeypatch.setattr(trie_lm, "SHARD_GRAMS", 300)
        monkeypatch.setattr(trie_lm, "COMMON", 1_000)
    draw = random.Random(8)
    texts = {i: " ".join(draw.choice(BASE[: 3 + i % 9]) for _ in range(draw.randrange(60))) for i in range(70)}
    cut = {d: ["s"] * (order - 1) + t.split() + ["end"] for d, t in texts.items()}
    out = {d: trie_lm.held_out(d) for d in cut}
    grams, contexts = Counter(), Counter()
    for w in (w for d, w in cut.items() if not out[d]):
        for j in range(order - 1, len(w)):
            for k in range(order):
                grams[tuple(w[j - k : j + 1])] += 1
                contexts[tuple(w[j - k : j])] += 1
    total, kinds = contexts[()], sum(len(g) == 1 for g in grams)
    got = by_id(trie_lm.scores(rows([(d, t, "x", 1) for d, t in texts.items()], SCHEMA).repartition(4), order=order))
    for doc, w in cut.items():
        want = 0.0
        for j in range(order - 1, len(w)):
            p = (grams[(w[j],)] + 0.5) / (total + 0.5 * (kinds + 1))
            for k in range(1, order):
                p = (grams[tuple(w[j - k : j + 1])] + trie_lm.MU * p) / (contexts[tuple(w[j - k : j])] + trie_lm.MU)
            want += np.log10(p)
        assert abs(got[doc]["score"] - want) <= 2e-3 * (len(w) - order + 1)


def test_trie_level_answers_with_childless_parents_and_absent_words():
    parent, word = np.array([1, 1, 3, 3]), np.array([2, 7, 0, 9])
    level = trie_lm.Level(parent, word, 5, np.full(4, 0.5), np.full(4, 0.5))
    asked = [(1, 2), (1, 7), (3, 0), (3, 9), (0, 2), (1, 0), (1, 9), (2, 0), (3, 7), (4, 0), (-1, 2)]
    assert level.find(*np.array(asked).T).tolist() == [0, 1, 2, 3, -1, -1, -1, -1, -1, -1, -1]


def test_anchors_are_the_first_smallest_grams_of_their_windows():
    draw, run = random.Random(3), repeats.SPAN - repeats.GRAM + 1
    for values in ([draw.randrange(6) for _ in range(400)], [7] * 90, list(range(99, 0, -1)), [5] * run):
        grams = np.array(values, np.uint64)
        want = [i + values[i : i + run].index(min(values[i : i + run])) for i in range(len(values) - run + 1)]
        window, place = repeats._smallest(grams, run)
        assert window[0] == 0 and (np.diff(place) != 0).all()
        assert np.repeat(place, np.diff(np.append(window, len(want)))).tolist() == want


def test_contexts_travel_with_four_bytes_of_their_bucket():
    data = bytes(random.Random(5).randrange(97, 123) for _ in range(4_000))
    block = {"block": 0, "doc_ids": [1, 2], "sizes": [len(data)] * 2, "n_bytes": 2 * len(data),
             "data": repeats.zstandard.ZstdCompressor().compress(data * 2)}
    marks, several = repeats._marks_of(block)
    rows = [r for r in repeats._asked(block, marks[several > 0], 1) if r[0] == 0]
    kept = repeats._contexts_of(block, marks[several > 0])
    bucket, sizes = repeats._unpacked(rows[0][2], "<u4", "<u2")
    assert bucket.tolist() == sorted(b >> 32 for b, _ in {(b, c) for b, c, _, _ in kept}) and len(sizes) == len(bucket)
