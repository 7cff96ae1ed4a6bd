"""Fill-in-middle training texts: two cuts at unit boundaries, the pieces put in a new order.

The characters of a batch of texts become classes, held in one wavelet matrix. The units of a text are
counted by the ranks of the classes that mark a boundary, at its start and end; both cuts are found by
bisection on the same ranks. No text is split into units.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.token_ids import batches
from cohortloom.llm.wavelet import WaveletMatrix

# The marks around the pieces.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)

# Classes of characters; white space other than the line end is one class, as is a word's first character.
INSIDE, LINE_END, BLANK, WORD_START, SENTENCE_END = range(5)
LEVELS = 3

# Code points that one wavelet matrix holds at most, unless a single text is longer.
MATRIX_CHARS = 2_000_000


@dataclass(frozen=True)
class Unit:
    """What a text is cut into: classes that mark a boundary, which lies behind or before the character."""

    marks: tuple[int, ...]
    behind: bool


UNITS = {
    "line": Unit((LINE_END,), True),
    "sentence": Unit((LINE_END, SENTENCE_END), True),
    "word": Unit((WORD_START,), False),
}

_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def _kinds(chars: np.ndarray, starts: np.ndarray, unit: Unit) -> np.ndarray:
    """Classes of code points; ``starts`` are the places where texts begin."""
    kinds = np.full(len(chars), INSIDE, np.uint8)
    if unit.marks != (LINE_END,):  # lines need no other class
        space = np.zeros(0x3001, bool)
        space[_SPACES] = True
        blank = space[np.minimum(chars, 0x3000)] & (chars <= 0x3000)
        after = np.ones(len(chars), bool)
        after[1:] = blank[:-1]
        after[starts[starts < len(chars)]] = True
        until = np.ones(len(chars), bool)
        until[:-1] = blank[1:]
        kinds[blank] = BLANK
        kinds[~blank & after] = WORD_START
        kinds[np.isin(chars, [ord("."), ord("!"), ord("?")]) & until & ~after] = SENTENCE_END
    kinds[chars == 10] = LINE_END
    return kinds


class Boundaries:
    """Unit counts and cuts of several texts, told by one wavelet matrix."""

    def __init__(self, texts: list[str], unit: str = "line") -> None:
        self.unit = UNITS[unit]
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.last = ends
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = _kinds(chars, self.first, self.unit)
        self.matrix = WaveletMatrix(kinds, LEVELS)
        self.before = self.matrix.count(self.unit.marks, self.first)
        marked = self.matrix.count(self.unit.marks, self.last)
        self.n = marked - self.before
        if self.unit.behind:  # what follows the last mark is a unit as well
            filled = self.last > self.first
            tail = np.maximum(self.last - 1, 0)
            self.n += filled & (self.matrix.count(self.unit.marks, tail) == marked)

    def cut(self, k: np.ndarray) -> np.ndarray:
        """Code points of each text before the end of its ``k``-th unit; 0 for none, all for the last."""
        found = self.last.copy()
        found[k == 0] = self.first[k == 0]
        inner = np.flatnonzero((k > 0) & (k < self.n))
        if len(inner):
            wanted = self.before[inner] + k[inner] + (not self.unit.behind)
            place = self.matrix.select(self.unit.marks, wanted, self.first[inner], self.last[inner])
            found[inner] = place - (not self.unit.behind)
        return found - self.first


def _draws(seed: int, name: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def _arranged(
    names: list[str | None], texts: list[str], unit: str, seed: int, rate: int, spm: int
) -> tuple[list, ...]:
    """Units, form, prefix and middle lengths and output of each text."""
    bounds = Boundaries(texts, unit)
    draws = np.array([_draws(seed, "" if x is None else x) for x in names], np.int64).reshape(-1, 4)
    one, two = draws[:, 0] % (bounds.n + 1), draws[:, 1] % (bounds.n + 1)
    begin, end = bounds.cut(np.minimum(one, two)), bounds.cut(np.maximum(one, two))
    forms, prefixes, middles, made = [], [], [], []
    for text, a, b, draw in zip(texts, begin.tolist(), end.tolist(), draws.tolist()):
        if not text or draw[2] % 100 >= rate or ("<" in text and any(m in text for m in MARKS)):
            forms.append("plain")
            prefixes.append(None)
            middles.append(None)
            made.append(text)
            continue
        form = "spm" if draw[3] % 100 < spm else "psm"
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        head = SUFFIX + suffix + PREFIX + prefix if form == "spm" else PREFIX + prefix + SUFFIX + suffix
        forms.append(form)
        prefixes.append(a)
        middles.append(b - a)
        made.append(head + MIDDLE + middle)
    return bounds.n.tolist(), forms, prefixes, middles, made


def infilled(
    docs: DataFrame,
    unit: str = "line",
    seed: int = 7,
    rate: int = 100,
    spm: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Each document in fill-in-middle form: doc_id, n, form, prefix_chars, middle_chars, output.

    ``unit`` is line, sentence or word; a sentence ends with its mark before white space or with its line,
    a word reaches to the start of the next one. ``rate`` per cent of the documents are rearranged, of these
    ``spm`` per cent with the suffix first. Draws depend on ``seed`` and id alone, so equal ids get equal
    draws; a null id draws as an empty one. Null and empty text, and text that holds a mark, stays as it
    is (plain, lengths null). Rows that repeat give equal rows; other columns are ignored. Ids keep their type.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}, not {unit!r}")
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(id_col).cast("string").alias("name"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    kind = base.schema["doc_id"].dataType.simpleString()

    def rearrange(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, names, texts = part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist()
            for a, b in batches(texts, MATRIX_CHARS):
                n, forms, prefixes, middles, made = _arranged(names[a:b], texts[a:b], unit, seed, rate, spm)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(forms, pa.string()),
                     pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(made, pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return base.mapInArrow(
        rearrange, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Each mark stands once in a rearranged output."""
    between = lambda left, right: F.split_part(
        F.split_part(output, F.lit(left), F.lit(2)), F.lit(right), F.lit(1)
    )
    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame) -> DataFrame:
    """Forms of ``infilled`` by line, with digests of the output and of the text rebuilt from it."""
    made = infilled(docs)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: The same by list slices, for the other engine.
SQL = r"""
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM (
  SELECT doc_id, t, n, coalesce(array_to_string(u[1:a], ''), '') AS p,
    coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
    FROM (
      SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
        CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
      FROM (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
          sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
        FROM documents))))"""
