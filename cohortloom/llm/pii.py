"""Personal data: fixed patterns, and spans that a character tagger adds.

The tagger is a bidirectional LSTM with CRF transitions, trained from the pattern spans of a bounded
sample, rewritten forms of them (at and dot in words or brackets, blanks, broken lines, short phone
numbers) and made sentences with and without personal data.

What the tagger may add is a closed form (``_plausible``): an e-mail has an at sign or the word at before
a name with a dot; the other kinds have a run of digits with few marks between. So text without these
needs no reading. Around each such place all text that a span of ``MAX_SPAN`` characters can reach is
read; longer regions are read in pieces that overlap by as much, so every span lies whole in one piece.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.bilstm_crf import Tagger, classes
from cohortloom.llm.common import texts

KINDS = ("email", "ip", "card", "phone")
FIT_DOCS = 3_000  # documents with pattern spans that the fit reads at most, by smallest hash of the id
FIT_WINDOWS = 900
MADE = 1_200  # made sentences of the fit
LENGTH, MARGIN, MIN_DIGITS = 128, 24, 7
MAX_SPAN = 254  # an e-mail address has no more characters
PIECE, BATCH = 1_024, 65_536  # characters decoded as one sequence, and at once

# The patterns of the four kinds. A match that starts inside a run of digits would also
# start at the head of the run, so the look-behind only saves tries.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Forms of what the tagger may add. Every e-mail has an ``_AT`` before ``_TAIL``; all digits of another
# kind lie in one ``_RUN``.
_DOT = r"(?:\s*[\[({<]\s*(?:\.|dot)\s*[\])}>]\s*|\s+dot\s+|\s?\.\s?)"
_NAME = r"[A-Za-z0-9_%+-]+"
_MAIL = re.compile(
    rf"{_NAME}(?:{_DOT}{_NAME})*(?:\s*[\[({{<]\s*(?:@|at)\s*[\])}}>]\s*|\s*@\s*|\s+at\s+){_NAME}(?:{_DOT}{_NAME})+", re.I
)
_AT = re.compile(r"@|\bat\b", re.I)
_TAIL = re.compile(rf"\s*(?:[\])}}>]\s*)?{_NAME}{_DOT}[A-Za-z0-9]", re.I)
_RUN = re.compile(r"[0-9](?:[^0-9A-Za-z]{0,4}[0-9])*")
_PHONE_FORM = re.compile(r"[+(]{0,2}[0-9](?:[ ().\-/\t\r\n]{0,4}[0-9])*")
_CARD_FORM = re.compile(r"[0-9](?:[ .\-/\t\r\n]{0,3}[0-9])*")
_SPELLED = r"(?:\s*[\[({<]\s*(?:\.|dot)\s*[\])}>]\s*|\s+dot\s+)"
_MORE = re.compile(rf"(?:(?:{_SPELLED}|\.){_NAME})+", re.I)
_LESS = re.compile(rf"(?<![A-Za-z0-9_%+-])(?:{_NAME}(?:{_SPELLED}|\.))+$", re.I)
_OPEN_END = re.compile(_DOT + "$", re.I)
# Addresses with an at sign, a bracketed at or a spelled dot need no tagger; "name at host.org" does.
_LOCAL_END = re.compile(rf"{_NAME}(?:(?:{_SPELLED}|\.){_NAME})*(?:\s*[\[({{<]\s*|\s*)$", re.I)
_WORD_DOT = re.compile(rf"\s+{_NAME}{_SPELLED}", re.I)
_HOST = re.compile(rf"\s*(?:[\])}}>]\s*)?{_NAME}(?:(?:{_SPELLED}|\.){_NAME})*(?:{_SPELLED}|\.)[A-Za-z]{{2,}}", re.I)
_IP_FORM = re.compile(r"[0-9]+(?: ?[\[(]?\.[\])]? ?[0-9]+){3}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the pattern spans in order; none for null."""
    if not text:
        return []
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > pos and text[left - 1] in _LOCAL:
            left -= 1
        found = _DOMAIN.match(text, at) if left < at else None
        if found:
            pos = found.end()
            out.append((left, pos, 0))
        at = text.find("@", max(at + 1, pos))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def _tagged(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for a, b, kind in spans:
        a, b = max(a, 0), min(b, length)
        if a < b and not tags[a:b].any():
            tags[a:b] = 2 + 2 * kind
            tags[a] = 1 + 2 * kind
    return tags


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = max(map(len, rows))
    x, mask = np.zeros((len(rows), length), np.int64), np.zeros((len(rows), length))
    for i, r in enumerate(rows):
        x[i, : len(r)], mask[i, : len(r)] = r, 1
    return x, mask


def _other_form(old: str, kind: int, draw: random.Random) -> str:
    """An instance of a kind written in another way."""
    if kind == 0:
        at = draw.choice([" @ ", " at ", " AT ", "(at)", " (at) ", "[at]", " [at] ", "@ ", " @"])
        dot = draw.choice([".", ".", " dot ", "(dot)", " [dot] "])
        local, _, host = old.partition("@")
        return (local.replace(".", dot) if "dot" in dot and draw.random() < 0.5 else local) + at + host.replace(".", dot)
    digits = [c for c in old if "0" <= c <= "9"]
    if kind == 1:
        return draw.choice(["[.]", " . ", "(.)"]).join(old.split("."))
    if kind == 2:
        return draw.choice([".", "\n", " - "]).join(
            "".join(digits[i : i + 4]) for i in range(0, len(digits), 4)
        )
    way = draw.randrange(4)
    if way == 0:
        return old.lstrip("+")
    if way == 1:
        last = "".join(digits[-draw.choice([7, 8]) :])
        return last[:-4] + draw.choice(["-", " ", "."]) + last[-4:]
    if way == 2:
        at = draw.randrange(4, max(5, len(old) - 3))
        return old[:at].rstrip() + draw.choice(["\n", "-\n"]) + old[at:].lstrip(" -")
    return draw.choice(["(0", "0"]) + "".join(digits[-9:-6]) + draw.choice([") ", "-", "/", " "]) + "".join(digits[-6:])


def _rewritten(window: str, spans: list, draw: random.Random) -> tuple[str, list]:
    """The window as it is or with its first span in another form."""
    if not spans or draw.random() < 0.3:
        return window, spans
    a, b, kind = spans[0]
    new = _other_form(window[a:b], kind, draw)
    moved = len(new) - (b - a)
    rest = [(x + moved, y + moved, k) for x, y, k in spans[1:] if x >= b]
    return window[:a] + new + window[b:], [(a, a + len(new), kind), *rest]


def made(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences of random words with one instance of a kind, mostly in another form, or with none."""
    draw, out = random.Random(seed), []
    word = lambda a=2, b=9: "".join(draw.choice("etaoinshrdlucmfwypvbgk") for _ in range(draw.randint(a, b)))
    num = lambda k: "".join(draw.choice("0123456789") for _ in range(k))

    def plain() -> str:
        y, m, d = draw.randint(1900, 2030), draw.randint(1, 12), draw.randint(1, 28)
        return draw.choice([
            f"{y}-{m:02d}-{d:02d}", f"{d:02d}/{m:02d}/{y}", f"{d}.{m}.{y}", f"{y}-{y + draw.randint(1, 9)}",
            num(draw.randint(7, 11)), f"{num(2)}:{num(2)}:{num(2)}.{num(3)}", f"{num(3)}.{num(6)}",
            f"{num(1)},{num(3)},{num(3)}", f"{num(4)} {num(4)}", f"{num(2)} {num(2)} {num(2)} {num(2)}",
            f"at {num(1)}.{num(2)} {word()}", f"at {word()}. {word().title()} {word()}", f"at {word()}. {word()}",
            f"look at {word()}.{word()} {word()}", f"v{num(1)}.{num(1)}.{num(2)} ({y})", f"@{word()} {word()}",
        ])

    def email() -> str:
        local = draw.choice(["", ".", "_"]).join(word() for _ in range(draw.randint(1, 5)))
        return f"{local}@{'.'.join(word() for _ in range(draw.randint(1, 2)))}.{word(2, 4)}"

    def card() -> str:
        head = num(15)
        return next(head + c for c in "0123456789" if _luhn(head + c))

    phone = lambda: f"+{num(draw.randint(1, 3))} {draw.choice(['({}) ', '{}-', '{} '])}".format(num(3)) + num(3) + draw.choice(["-", " "]) + num(4)
    ip = lambda: ".".join(str(draw.randint(0, 255)) for _ in range(4))
    cues = (
        ["mail", "e-mail:", "write to", "contact", "reach me:", ""], ["ip", "host", "address", ""],
        ["card", "paid with", "number:", ""], ["call", "phone:", "tel.", "mobile", "fax", ""],
    )
    for _ in range(n):
        before = " ".join(word() for _ in range(draw.randint(0, 5)))
        after = draw.choice([" ", ", ", ". ", "\n"]) + " ".join(word() for _ in range(draw.randint(0, 4)))
        after = draw.choice([after, after, after, ""])
        if draw.random() < 0.4:
            out.append((f"{before} {plain()}{after}", []))
            continue
        kind = draw.choice([0, 0, 0, 1, 2, 3, 3])
        value = (email, ip, card, phone)[kind]()
        if draw.random() < 0.8:
            value = _other_form(value, kind, draw)
        head = f"{before} {draw.choice(cues[kind])} "
        out.append((head + value + after, [(len(head), len(head) + len(value), kind)]))
    return out


def train(docs: DataFrame, fit_docs: int = FIT_DOCS) -> dict:
    """Parameters fitted on windows of a bounded sample and on made sentences."""

    @F.pandas_udf("array<struct<w:string,s:array<array<int>>>>")
    def windows(text: pd.Series) -> pd.Series:
        def of(t):
            out = []
            for a, _, _ in base_spans(t)[:8]:  # a sample of windows for the fit
                lo = max(0, a - MARGIN)
                hi = min(lo + LENGTH - 28, len(t))
                out.append({"w": t[lo:hi], "s": [[x, y, k] for x, y, k in base_spans(t[lo:hi])]})
            return out

        return text.map(of)

    chosen = (
        texts(docs).filter(F.col("text").rlike("[0-9]|@"))
        .select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
        .select("doc_id", F.explode(windows("text")).alias("v"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "v.w").limit(FIT_WINDOWS).select("v.*").collect()
    )
    draw = random.Random(5)
    labelled = [_rewritten(row["w"], [tuple(s) for s in row["s"]], draw) for row in chosen]
    return fitted(labelled + made(MADE, 11))


def fitted(labelled: list[tuple[str, list]]) -> dict:
    """Parameters fitted on labelled texts."""
    xs, mask = _padded([classes(text[:LENGTH]) for text, _ in labelled])
    ys, _ = _padded([_tagged(min(len(text), LENGTH), spans) for text, spans in labelled])
    model = Tagger(1 + 2 * len(KINDS))
    model.fit(xs, ys, mask, batch=64, rate=0.03)
    return model.p


def regions(text: str, base: list) -> list[tuple[int, int]]:
    """Pieces of the text that hold, whole, every span of a plausible form that overlaps no pattern span."""
    places = []
    covered = lambda a, b: any(x <= a and b <= y for x, y, _ in base)
    for m in _AT.finditer(text):
        a, b = m.span()
        if not covered(a, b) and _TAIL.match(text, b):
            places.append((b - MAX_SPAN, a + MAX_SPAN))
    for m in _RUN.finditer(text):
        a, b = m.span()
        digits = b - a >= MIN_DIGITS and (sum(map(m[0].count, "0123456789")) >= MIN_DIGITS or m[0].count(".") >= 3)
        if digits and not covered(a, b):
            places.append((a - MARGIN, b + MARGIN))
    merged: list[list[int]] = []
    for a, b in sorted((max(a, 0), min(b, len(text))) for a, b in places):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [
        (s, min(s + PIECE, b)) for a, b in merged for s in range(a, max(a + 1, b - MAX_SPAN), PIECE - MAX_SPAN)
    ]


def strong(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, -1) of addresses around an at sign, bracketed at or spelled dot, for what the tagger leaves."""
    out = []
    for m in _AT.finditer(text):
        closed = text[max(0, m.start() - 3) : m.start()].rstrip().endswith(("[", "(", "{", "<"))
        if m[0] != "@" and not closed and not _WORD_DOT.match(text, m.end()):
            continue
        host, lo = _HOST.match(text, m.end()), max(0, m.start() - MAX_SPAN)
        local = _LOCAL_END.search(text[lo : m.start()]) if host else None
        if local:
            out.append((lo + local.start(), host.end(), 0, -1))
    return out


def decoded(model: Tagger, values: list, bases: list) -> list[list[tuple[int, int, int, int]]]:
    """(start, end, kind, distance from the piece's edges) of what may be added to each text."""
    found: list[list[tuple[int, int, int, int]]] = [strong(t) if t else [] for t in values]
    pieces = [(i, a, b) for i, t in enumerate(values) if t for a, b in regions(t, bases[i])]
    pieces.sort(key=lambda p: p[2] - p[1])
    while pieces:
        rows = max(1, BATCH // (pieces[-1][2] - pieces[-1][1]))
        part, pieces = pieces[-rows:], pieces[:-rows]
        x, mask = _padded([classes(values[i][a:b]) for i, a, b in part])
        for (i, a, b), tags in zip(part, model.decode(x, mask)):
            for j in np.flatnonzero(tags % 2 == 1).tolist():
                k, inner = j + 1, tags[j] + 1
                while k < b - a and tags[k] == inner:
                    k += 1
                start, end = _snapped(values[i], a + j, a + k, int(inner // 2 - 1))
                found[i].append((start, end, int(inner // 2 - 1), min(j, b - a - k)))
    return found


def _snapped(text: str, a: int, b: int, kind: int) -> tuple[int, int]:
    """The span without blanks at its ends, carried on to the ends of its first and last word or number."""
    while a < b and text[a].isspace():
        a += 1
    if kind == 0 and (m := _OPEN_END.search(text[a:b])):
        b = a + m.start()
    while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
        b -= 1
    inside = _LOCAL if kind == 0 else frozenset("0123456789")
    while a > 0 and text[a - 1] in inside:
        a -= 1
    if kind == 3:
        while a > 0 and text[a - 1] in "+(":
            a -= 1
    while b < len(text) and text[b] in inside and text[b] != ".":
        b += 1
    if kind == 0:
        b = m.end() if (m := _MORE.match(text, b)) else b
        lo = max(0, a - MAX_SPAN)
        a = lo + m.start() if (m := _LESS.search(text[lo:a])) else a
    return a, b


def _plausible(text: str, kind: int) -> bool:
    if len(text) > MAX_SPAN:
        return False
    digits = [c for c in text if "0" <= c <= "9"]
    if kind == 0:
        return _MAIL.fullmatch(text) is not None
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return _IP_FORM.fullmatch(text) is not None and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 12 <= len(digits) <= 19 and _CARD_FORM.fullmatch(text) is not None and _luhn("".join(digits))
    return MIN_DIGITS <= len(digits) <= 15 and _PHONE_FORM.fullmatch(text) is not None


def all_spans(text: str, base: list, added: list) -> list[tuple[int, int, int]]:
    """Pattern spans and the tagger's spans that overlap none of them, nor one another."""
    kept = list(base)
    for a, b, kind, _ in sorted(added, key=lambda s: (-s[3], s[0], s[1])):
        if _plausible(text[a:b], kind) and not any(x < b and a < y for x, y, _ in kept):
            kept.append((a, b, kind))
    return sorted(kept, key=lambda s: (s[0], s[2]))


def _written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


_models: dict[int, Tagger] = {}


def _model(params: dict) -> Tagger:
    if id(params) not in _models:
        _models.clear()
        model = Tagger(1 + 2 * len(KINDS))
        model.p = params
        _models[id(params)] = model
    return _models[id(params)]


def found(docs: DataFrame, params: dict, text_col: str = "text", name: str = "pii") -> DataFrame:
    """Add a struct with counts, digest, spans and the text with each span replaced by its kind."""
    shared = docs.sparkSession.sparkContext.broadcast(params)  # a few thousand numbers

    @F.pandas_udf(
        "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string"
    )
    def scan(text: pd.Series) -> pd.DataFrame:
        rows, model, values = [], _model(shared.value), text.tolist()
        bases = [base_spans(t) for t in values]
        for t, base, added in zip(values, bases, decoded(model, values, bases)):
            every = all_spans(t, base, added)
            counts = [sum(k == i for _, _, k in base) for i in range(len(KINDS))]
            out, at = [], 0
            for a, b, k in every:
                if b <= at:
                    continue
                out += [t[at : max(a, at)], f"[{KINDS[k].upper()}]" if a >= at else ""]
                at = b
            masked = "".join(out) + t[at:] if every else t
            digest = hashlib.sha256(_written(base).encode()).hexdigest()
            rows.append((*counts, digest, _written(every), masked))
        return pd.DataFrame(
            rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked"]
        )

    return docs.select("*", scan(F.col(text_col)).alias(name))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the pattern spans, and all spans.

    Null and empty texts have no spans. Offsets are code points. Other columns are ignored.
    """
    base = texts(docs, id_col, text_col)
    return found(base, train(base)).select(
        "doc_id", *[f"pii.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")]
    )


def mask(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind; all other columns as they came."""
    out = found(docs, train(docs), name="__pii")
    return out.select(*[F.col("__pii.masked").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
