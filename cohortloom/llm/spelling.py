"""Spelling variants: words of a corpus that lie one edit apart, and the common form each one stems from.

Two words one edit apart agree before or behind the edit. A word is therefore filed under its first and
under its last half, as the shorter and as the longer word of a pair, and pairs meet within such a group:
``(length of the shorter word, place range of the edit, what surrounds that range)``. The place of the edit
is the length of the common prefix, so that each pair belongs to one group only. A group of too many words
is split by halving its range of places until it is small enough; a range of one place holds no more words
than the alphabet allows.

Within a group the words are sorted and scanned with the edit matrix of each shorter word. Rows of that
matrix are banded (three cells) and belong to a shared prefix: adjacent common-prefix lengths tell which
range of the list shares one, the row is computed once for the range, and the range is left as soon as its
row exceeds one edit. Ranges of all words of a group advance together, a character at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import cut_lineage

# The letters of a word.
LETTERS = "A-Za-zÀ-ÿ"

# Occurrences of a word before those of a near word that count as its form.
RATIO = 10

# A group of more words is split.
GROUP_WORDS = 50_000

# Words that are scanned at once, as whole groups; and ranges of the list that are open at once.
SCAN_WORDS = 40_000
OPEN_RANGES = 400_000

# Distinct words that one task holds before it hands them on.
HELD_WORDS = 300_000

_FAR = 2  # any distance beyond one edit


def occurrences(
    docs: DataFrame,
    min_chars: int = 7,
    every: int = 31,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Words of whole texts with their number of uses (word, n).

    Runs of letters, A to Z lower-cased. A run whose crc32 with its id is a multiple of ``every`` loses one
    character (``every`` 0: none does). Words of fewer than ``min_chars`` characters are left out. Null
    text has no words; a null id counts as an empty one; repeated rows count again.
    """
    find = re.compile(f"[{LETTERS}]{{{min_chars},}}").findall  # a shorter run only gets shorter
    base = docs.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"))

    def counted(held: Counter) -> pa.RecordBatch:
        arrays = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["word", "n"])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        crc32 = zlib.crc32
        for part in parts:
            # lower-casing the bytes changes A to Z only
            for name, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                if not text:
                    continue
                runs = find(text.lower().decode())
                if not every:
                    held.update(runs)
                    continue
                start = crc32(f"{name or ''}:".encode())
                found = Counter(runs)
                for run in [r for r in found if crc32(r.encode(), start) % every == 0]:
                    n, at = found.pop(run), crc32(run.encode(), start) % len(run)
                    if len(run) > min_chars:
                        held[run[:at] + run[at + 1 :]] += n
                for run, n in found.items():
                    held[run] += n
                if len(held) > HELD_WORDS:
                    yield counted(held)
                    held = Counter()
        if held:
            yield counted(held)

    rows = base.mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _ranges(words: DataFrame) -> DataFrame:
    """Each word under both halves, as the shorter and the longer one: (size, low, high, word, n)."""
    return words.select(
        "word",
        "n",
        F.explode(
            F.expr(
                """flatten(transform(array(length(word), length(word) - 1), s -> array(
                     named_struct('size', s, 'low', 0, 'high', cast(s div 2 AS int)),
                     named_struct('size', s, 'low', cast(s div 2 AS int), 'high', s + 1))))"""
            )
        ).alias("r"),
    ).select("word", "n", "r.*").filter("low < high")


def _keyed(rows: DataFrame) -> DataFrame:
    """Add what surrounds the places low to high: the group of a row is (size, low, high, around)."""
    around = F.expr("concat(left(word, low), ' ', right(word, greatest(size - high, 0)))")
    return rows.select("size", F.col("low").cast("int"), F.col("high").cast("int"), "word", "n", around.alias("around"))


GROUP = ("size", "low", "high", "around")


def grouped(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """Words (word, n) filed into groups of at most ``group_words`` words or of one place for the edit."""
    done: list[DataFrame] = []
    rows = cut_lineage(_keyed(_ranges(words)), "spelling-groups")
    while True:
        sizes = rows.groupBy(*GROUP).count()
        large = sizes.filter((F.col("count") > group_words) & (F.col("high") - F.col("low") > 1))
        large = cut_lineage(large.select(*GROUP), "spelling-large")
        if large.isEmpty():
            break
        done.append(rows.join(large, list(GROUP), "left_anti"))
        middle = F.expr("(low + high) div 2")
        halves = rows.join(large, list(GROUP), "left_semi").select(
            "size",
            "word",
            "n",
            F.explode(
                F.array(
                    F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high"))
                )
            ).alias("r"),
        )
        rows = cut_lineage(_keyed(halves.select("size", "word", "n", "r.*")), "spelling-groups")
    for part in done:
        rows = rows.unionByName(part)
    return rows


class SortedWords:
    """Sorted words of several groups: characters, lengths, and common prefixes of neighbours by length."""

    def __init__(self, words: list[str], group: np.ndarray) -> None:
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        self.chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        common = np.zeros(len(words), np.int64)
        shorter = np.zeros(len(words), np.int64)
        shorter[1:] = np.minimum(self.size[1:], self.size[:-1])
        live = np.flatnonzero(shorter)
        while len(live):
            at = common[live]
            same = self.chars[self.start[live] + at] == self.chars[self.start[live - 1] + at]
            common[live[same]] += 1
            live = live[same & (at + 1 < shorter[live])]
        # where a group begins, nothing is shared
        first = np.ones(len(words), bool)
        first[1:] = group[1:] != group[:-1]
        common[first] = -1
        order = np.argsort(common, kind="stable")
        self.by_common, self.common = order, common[order]
        self.begin = np.flatnonzero(first)
        self.end = np.append(self.begin[1:], len(words))

    def breaks(self, depth: int) -> np.ndarray:
        """Ascending places at which exactly ``depth`` characters are shared with the word before."""
        a, b = np.searchsorted(self.common, [depth, depth + 1])
        return self.by_common[a:b]

    def char(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The character of each word at a place; 0 beyond its ends."""
        inside = (at >= 0) & (at < self.size[word])
        return np.where(inside, self.chars[self.start[word] + np.where(inside, at, 0)], 0)


def near_pairs(
    words: list[str], group: np.ndarray, shorter: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of places in ``words`` that are one edit apart, by scanning each group.

    Words are sorted within ascending groups. ``shorter`` is the length of the shorter word of a group's
    pairs, ``low`` and ``high`` bound the length of their common prefix, each given per word. Two words of
    equal length come out in both orders.
    """
    table = SortedWords(words, group)
    queries = np.flatnonzero(table.size == shorter)
    at = np.searchsorted(table.begin, queries, side="right") - 1
    found_a, found_b = [], []
    # a query opens no more ranges than its group has words, and seldom more than this
    weight = np.cumsum(np.minimum(table.end[at] - table.begin[at], 400)) // OPEN_RANGES
    for block in np.split(np.arange(len(queries)), np.flatnonzero(np.diff(weight)) + 1):
        a, b = _scan(table, queries[block], table.begin[at[block]], table.end[at[block]], low, high)
        found_a.append(a)
        found_b.append(b)
    return np.concatenate(found_a), np.concatenate(found_b)


def _scan(table: SortedWords, query, first, last, low, high) -> tuple[np.ndarray, np.ndarray]:
    """Advance the open ranges ``first`` to ``last`` of each query one character at a time.

    ``left``, ``same`` and ``right`` are the banded row: edits between the range's prefix of ``depth``
    characters and the query's prefix of ``depth - 1``, ``depth`` and ``depth + 1``.
    """
    out_a, out_b = [], []
    n = len(query)
    left = np.full(n, _FAR, np.int8)
    same = np.zeros(n, np.int8)
    right = np.ones(n, np.int8)
    depth = 0
    while len(query):
        # words that end here stand first in their range
        ended = table.size[first] == depth
        if ended.any():
            length = table.size[query]
            edits = np.where(length == depth, same, np.where(length == depth - 1, left, _FAR))
            hit = ended & (edits == 1)
            out_a.append(query[hit])
            out_b.append(first[hit])
            first = first + ended
            open_ = first < last
            query, first, last = query[open_], first[open_], last[open_]
            left, same, right = left[open_], same[open_], right[open_]
        # a range becomes one range for each character that follows its prefix
        breaks = table.breaks(depth)
        a, b = np.searchsorted(breaks, first, side="right"), np.searchsorted(breaks, last, side="left")
        parts = b - a + 1
        parent = np.repeat(np.arange(len(query)), parts)
        nth = np.arange(len(parent)) - np.repeat(np.cumsum(parts) - parts, parts)
        cut = np.append(breaks, 0)[np.minimum(a[parent] + nth, len(breaks))]
        before = np.append(breaks, 0)[np.clip(a[parent] + nth - 1, 0, len(breaks))]
        first_c = np.where(nth == 0, first[parent], before)
        last_c = np.where(nth == parts[parent] - 1, last[parent], cut)
        query = query[parent]
        char = table.chars[table.start[first_c] + depth]
        differs = char != table.char(query, np.full(len(query), depth))
        exact = same[parent] == 0
        # the first difference must lie within the group's range of places
        allowed = np.where(
            exact,
            np.where(differs, (depth >= low[query]) & (depth < high[query]), depth + 1 < high[query]),
            True,
        )
        l, s, r = left[parent], same[parent], right[parent]  # noqa: E741
        new_left = np.minimum(l + (char != table.char(query, np.full(len(query), depth - 1))), s + 1)
        new_same = np.minimum(np.minimum(s + differs, r + 1), new_left + 1)
        new_right = np.minimum(r + (char != table.char(query, np.full(len(query), depth + 1))), new_same + 1)
        length = table.size[query]
        new_same = np.where(depth + 1 > length, _FAR, new_same)
        new_right = np.where(depth + 2 > length, _FAR, new_right)
        keep = allowed & (np.minimum(np.minimum(new_left, new_same), new_right) < _FAR)
        query, first, last = query[keep], first_c[keep], last_c[keep]
        left, same, right = (np.minimum(x[keep], _FAR).astype(np.int8) for x in (new_left, new_same, new_right))
        depth += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _best(words: list[str], n: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], equal: np.ndarray):
    """Per word its near words in these pairs: (word places, number, place of the most used one)."""
    a, b = pairs
    longer = ~equal
    own = np.concatenate([a, b[longer]])
    other = np.concatenate([b, a[longer]])
    order = np.lexsort((-n[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    count = np.diff(np.append(first, len(own)))
    best = other[first]
    # of equally used ones, the first in the order of words
    top = np.repeat(n[best], count) == n[other]
    ties = np.add.reduceat(top.astype(np.int64), first) if len(first) else first
    for i in np.flatnonzero(ties > 1):
        best[i] = min(other[first[i] : first[i] + ties[i]].tolist(), key=words.__getitem__)
    return own[first], count, best


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """How many words of (word, n) are one edit from each, and the most used of them (ties: the first by
    code points): (word, n_near, near, near_n). Words without one are absent; words must be distinct."""
    filed = grouped(words, group_words)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = filed.repartition(parts, *GROUP).sortWithinPartitions(*GROUP, "word")

    def scanned(table: pa.Table) -> pa.RecordBatch:
        names = table.column("word").to_pylist()
        keys = [table.column(c).combine_chunks() for c in GROUP]
        group = np.zeros(len(names), np.int64)
        for key in keys:
            codes = key.dictionary_encode().indices.to_numpy()
            group[1:] |= codes[1:] != codes[:-1]
        group = np.cumsum(group)
        shorter, low, high = (keys[i].to_numpy().astype(np.int64) for i in range(3))
        n = table.column("n").to_numpy()
        pairs = near_pairs(names, group, shorter, low, high)
        size = np.fromiter(map(len, names), np.int64, len(names))
        own, count, best = _best(names, n, pairs, size[pairs[0]] == size[pairs[1]])
        return pa.RecordBatch.from_arrays(
            [table.column("word").combine_chunks().take(pa.array(own)), pa.array(count, pa.int64()),
             table.column("word").combine_chunks().take(pa.array(best)), pa.array(n[best], pa.int64())],
            ["word", "n_near", "near", "near_n"],
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < SCAN_WORDS:
                continue
            table = pa.Table.from_batches(held)
            # whole groups only: the last one may go on in the next batch
            in_last = np.ones(rows, bool)
            for c in GROUP:
                in_last &= pc.equal(table.column(c), table.column(c)[rows - 1]).to_numpy()
            tail = int(np.argmax(in_last))
            if tail:
                yield scanned(table.slice(0, tail))
            held = table.slice(tail).to_batches()
            rows -= tail
        if rows:
            yield scanned(pa.Table.from_batches(held))

    pairs = ordered.mapInArrow(scan, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    merged = pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n_near", F.col("b.w").alias("near"), (-F.col("b.m")).alias("near_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """Follow (word, form) to the last form: (word, root), for words that have a form.

    Each form is used at least ``RATIO`` times as often as its word, so chains are short and end; each
    round doubles how far a word has come.
    """
    steps = cut_lineage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(
            steps.join(on, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "spelling-roots",
        )
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return steps


def variants(
    docs: DataFrame,
    min_chars: int = 7,
    min_uses: int = 2,
    ratio: int = RATIO,
    every: int = 31,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Words of ``min_uses`` uses or more with their variants: word, form, root, n, n_near, form_n.

    ``form`` is the most used word one edit away (ties: the first by code points) if it has ``ratio`` times
    the uses or more, else null with a null ``form_n``; ``root`` is the last of the chain of forms, the word
    itself without one. Null and empty texts have no words, an empty table gives no rows. See
    ``occurrences`` for the words; columns beside id and text are ignored.
    """
    if ratio <= 1:
        raise ValueError("the ratio must exceed 1, or chains of forms need not end")
    counts = occurrences(docs, min_chars, every, id_col, text_col)
    words = cut_lineage(counts.filter(F.col("n") >= min_uses), "spelling-words")
    near = near_words(words)
    formed = F.when(F.col("near_n") >= ratio * F.col("n"), F.struct("near", "near_n"))
    known = words.join(near, "word", "left").withColumn("f", formed).select(
        "word", F.col("f.near").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.col("f.near_n").alias("form_n"),
    )
    known = cut_lineage(known, "spelling-forms")
    roots = rooted(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
