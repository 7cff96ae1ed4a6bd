"""Text expressions."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marker left by de-identification and what replaces it.
REDACTION_MARKER = "_{2,}"
REDACTION_TEXT = " [REDACTED] "

# Unicode white space: Java's own \s class misses the separators and the control characters.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
SPACE_CHARS = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
NOT_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]+"

# A word is a run of at least two letters, digits or underscores; Python finds them.
WORD = r"\w{2,}"

# Texts whose words are Python objects at once.
CUT_TEXTS = 500


def squeeze_space(text: Column) -> Column:
    """Runs of white space become one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def clean_text(text: Column) -> Column:
    """Replace redaction markers, normalise white space; null gives the empty string."""
    marked = F.regexp_replace(text, REDACTION_MARKER, REDACTION_TEXT)
    return F.coalesce(squeeze_space(marked), F.lit(""))


def token_length(text: Column) -> Column:
    """Number of white-space separated tokens; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0))


def clean_token_length(cleaned: Column) -> Column:
    """``token_length`` of a text that ``clean_text`` has been through: blanks plus one."""
    blanks = F.length(cleaned) - F.length(F.replace(cleaned, F.lit(" "), F.lit("")))
    return F.when(cleaned == "", F.lit(0)).otherwise(blanks + 1)


def char_length(text: Column) -> Column:
    """Number of code points; null gives 0."""
    return F.length(F.coalesce(text, F.lit("")))


def count_deid_markers(text: Column) -> Column:
    """Number of redaction markers in the raw text; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(REDACTION_MARKER)), F.lit(0))


def _folded(texts: pa.Array) -> pa.Array:
    def fold(text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        parts = unicodedata.normalize("NFKD", text)
        for char in set(parts):
            if unicodedata.combining(char):
                parts = parts.replace(char, "")
        return parts

    return pa.array([fold(text) for text in texts.to_pylist()], pa.string())


def _words(texts: pa.Array) -> pa.Array:
    find, kind = re.compile(WORD).findall, pa.list_(pa.string())
    parts = [
        pa.array([None if text is None else find(text) for text in texts.slice(at, CUT_TEXTS).to_pylist()], kind)
        for at in range(0, len(texts), CUT_TEXTS)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _row_of_each(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each item of all lists its row, and the number of items of each row."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), sizes


def list_array(sizes: np.ndarray, items: pa.Array, null: np.ndarray | None = None) -> pa.ListArray:
    """Lists of the given sizes, filled from ``items`` one after the other."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), items, mask=None if null is None else pa.array(null))


def _ngrams(words: pa.Array, low: int, high: int) -> pa.Array:
    rows, _ = _row_of_each(words)
    flat = grams = words.flatten()
    found, owners = [], []
    for n in range(1, high + 1):
        if n > 1:
            # the n-gram at i is the (n-1)-gram at i followed by the word at i + n - 1
            heads = grams.slice(0, max(len(flat) - n + 1, 0))
            grams = pc.binary_join_element_wise(heads, flat.slice(min(n - 1, len(flat))), " ")
        if n >= low:
            inside = np.flatnonzero(rows[: len(grams)] == rows[len(rows) - len(grams) :])
            found.append(grams.take(pa.array(inside)))
            owners.append(rows[inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    items = pa.concat_arrays(found).take(pa.array(order))
    return list_array(np.bincount(owner, minlength=len(words)), items, words.is_null().to_numpy(zero_copy_only=False))


def gram_lists(lowered: pa.Array, low: int, high: int) -> pa.Array:
    """The n-grams of lower-cased texts, as ``word_ngrams`` of ``tokenize_words`` has them."""
    return _ngrams(_words(_folded(lowered)), low, high)


def fold_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks, for every character of Unicode.

    The order that decomposition gives to the marks does not matter, since all of them are dropped. Texts of
    ASCII alone stay as they are.
    """
    return F.arrow_udf(_folded, T.StringType())(text)


def tokenize_words(text: Column) -> Column:
    """Lower-cased, accent-folded words of at least two characters, in text order."""
    folded = fold_accents(F.lower(F.coalesce(text, F.lit(""))))
    return F.arrow_udf(_words, T.ArrayType(T.StringType()))(folded)


def word_ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams of ``low`` to ``high`` words, words joined by a blank, shortest first."""

    def ngrams(words: pa.Array) -> pa.Array:
        return _ngrams(words, low, high)

    return F.arrow_udf(ngrams, T.ArrayType(T.StringType()))(words)


def redacted_context(text: Column, start: Column, length: Column, window: int = 40) -> Column:
    """``window`` characters on both sides of a match, which itself is blotted out.

    ``start`` is the 1-based position of the match.
    """
    first = F.greatest(start - window, F.lit(1))
    before = F.substring(text, first, start - first)
    after = F.substring(text, start + length, F.lit(window))
    return squeeze_space(F.concat(F.lit("..."), before, F.lit("[REDACTED]"), after, F.lit("...")))


def caseless(text: Column) -> Column:
    """Lower-cased text in which the letters that match an ASCII one regardless of case are it."""
    return F.lower(F.translate(text, "\u017f\u0131\u0130\u212a", "siik"))


def match_start(text: Column, pattern: str) -> Column:
    """1-based code-point position of the first match, 0 without one.

    Measured on the text before the match, since ``regexp_instr`` counts UTF-16 units and would
    drift behind characters outside the basic plane.
    """
    before = F.split(text, pattern, 2)[0]
    return F.when(text.rlike(pattern), F.length(before) + 1).otherwise(F.lit(0))
