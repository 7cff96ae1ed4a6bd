"""N-gram Jaccard join with prefix filters under several global orders.

Texts become sets of hashed word shingles. Equal sets are one class. A set's prefix under a global order
holds its first ``n - ceil(t n) + 1`` tokens; two sets with similarity t share a prefix token under every
order, and up to the nearer end of their prefixes they differ by no more tokens than similar sets may.
Pairs that pass both tests under all orders are verified. All orders put the most frequent prefix tokens
last, which changes which pairs are tried and never which are found.

A set also has a sketch: the parity of its tokens in each of some cells. A token that one of two sets lacks
turns one cell, so sets differ by no fewer tokens than their sketches by cells; pairs that differ by more than
similar sets may are dropped where they meet, before their prefixes are fetched.

Large groups: each prefix token first links its sets to one of them, drawn per token (as many tries as
rows). Sets that verified links already join need no further pair, since only the component counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import components, texts, union
from cohortloom.session import cut_lineage, discard

# Prefix tokens of more sets than LATE_COUNT go to the end of every order, or of so many sets that no more than
# LATE_TOKENS do. They are marked in a bitmap of fixed size, in which a few others share their bits.
LATE_COUNT = 3
LATE_TOKENS = 3_000_000
LATE_BITS = 27
ORDERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd multipliers, each giving an order

# Numbers of 64 cells in the sketch of a set, and in the shorter one that its prefix tokens carry.
SKETCH, SHORT = 16, 4

# Words known at once in one Python worker, and ids that are broadcast at most (8 bytes each).
CACHE_WORDS = 100_000
BROADCAST_IDS = 1_000_000

# Rows of a batch that is followed by others, unless their texts are long.
FULL_BATCH = 1_000

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_HIGH = np.uint64(1 << 63)
_word_hash: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words between white space of the ASCII range; bytes know no other letters or spaces."""
    return text.lower().split() if text else []


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words; a shorter text is one run."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    if len(_word_hash) > CACHE_WORDS:
        _word_hash.clear()
    for w in set(found).difference(_word_hash):
        _word_hash[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_word_hash.__getitem__, found), np.uint64, len(found))
    run = min(size, len(h))
    out = np.full(len(h) - run + 1, run, np.uint64)
    for i in range(run):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - run + 1 + i])
    return np.unique(out)


def _bits(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Octet and bit of each token in the bitmap."""
    place = _mixed(tokens) >> np.uint64(64 - LATE_BITS)
    return place >> np.uint64(3), np.left_shift(1, (place & np.uint64(7)).astype(np.uint8), dtype=np.uint8)


def _marked(late: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    octet, bit = _bits(tokens)
    return (late[octet] & bit) != 0


def prefix(tokens: np.ndarray, order: int, percent: int, late: np.ndarray) -> np.ndarray:
    """Ascending ranks of the first tokens of a set under an order, enough to meet every similar set.

    A rank stands for its token: 63 bits of a one-to-one product, above them one for late tokens. It is
    shifted so that signed numbers keep the order.
    """
    n = len(tokens)
    length = n - -(-n * percent // 100) + 1 if n else 0
    rank = (tokens * np.uint64(order)) >> np.uint64(1)
    if n:
        rank = np.where(_marked(late, tokens), rank | _HIGH, rank)
    if length < n:
        rank = np.partition(rank, length - 1)[:length]
    return (np.sort(rank) ^ _HIGH).view(np.int64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``SKETCH`` numbers for each set: 64 cells each, set where an odd number of tokens falls."""
    cells = 64 * SKETCH
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)) * cells, [len(s) for s in sets])
    odd = np.bincount(owner + (tokens % np.uint64(cells)).astype(np.int64), minlength=len(sets) * cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").reshape(-1, SKETCH)


def _near_sketches(a: str, b: str, percent: int, numbers: int) -> Column:
    """Whether the first ``numbers`` of the sketches under two aliases allow the similarity.

    Similar sets differ by (1 - t) / (1 + t) of their sizes' sum at most.
    """
    turned = reduce(add, [F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(numbers)])
    return turned * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)


def _folded() -> list[Column]:
    """The sketch with its cells laid on top of each other, which leaves ``SHORT`` numbers."""
    parts = [[F.col(f"s{j}") for j in range(i, SKETCH, SHORT)] for i in range(SHORT)]
    return [reduce(Column.bitwiseXOR, part).alias(f"s{i}") for i, part in enumerate(parts)]


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(rep, toks) for the given documents (doc_id, text)."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for ids, values in _slices(batch):
                sets = [shingles(t, size).view(np.int64) for t in values]
                yield pa.RecordBatch.from_arrays([ids, _lists(sets)], ["rep", "toks"])

    return docs.mapInArrow(make, "rep long, toks array<long>")


def _slices(batch: pa.RecordBatch, rows: int = 256):
    """Ids and texts of a batch in steps. A worker goes on to other stages, which need its memory."""
    for i in range(0, batch.num_rows, rows):
        part = batch.slice(i, rows)
        yield part.column(0), part.column(1).cast(pa.binary()).to_pylist()
    if batch.num_rows < FULL_BATCH:  # the last one of its task
        _word_hash.clear()
        pa.default_memory_pool().release_unused()


def _lists(sets: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _prefixes(docs: DataFrame, size: int, percent: int, late) -> DataFrame:
    """(doc_id, n, digest, s0, s1, .., p0, p1): set size, 128-bit digest of the set, its sketch and its prefixes."""
    names = [f"s{i}" for i in range(SKETCH)]

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        behind = late.value
        for batch in parts:
            for ids, values in _slices(batch):
                sets = [shingles(t, size) for t in values]
                firsts = [_lists([prefix(s, o, percent, behind) for s in sets]) for o in ORDERS]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        *[pa.array(np.ascontiguousarray(column)) for column in sketches(sets).T],
                        *firsts,
                    ],
                    ["doc_id", "n", "digest", *names, "p0", "p1"],
                )

    numbers = ", ".join(f"{name} long" for name in names)
    return docs.mapInArrow(make, f"doc_id long, n long, digest binary, {numbers}, p0 array<long>, p1 array<long>")


def _tokens(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(t): tokens of the prefixes of each set under all orders, each once a set."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for _, values in _slices(batch):
                out = []
                for tokens in (shingles(t, size) for t in values):
                    n = len(tokens)
                    length = n - -(-n * percent // 100) + 1
                    if length >= n:
                        out.append(tokens)
                        continue
                    first = [np.argpartition(tokens * np.uint64(o), length - 1)[:length] for o in ORDERS]
                    out.append(tokens[np.unique(np.concatenate(first))])
                flat = np.concatenate(out).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat)], ["t"])

    return docs.mapInArrow(make, "t long")


def _late(counts: DataFrame) -> np.ndarray:
    """Bitmap of the frequent tokens of written (t, count); how often, follows from how many there are."""
    least, total = LATE_COUNT, 0
    for row in counts.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count")).collect():
        total += row["n"]
        if total > LATE_TOKENS:
            least = row["count"]
            break
    late = np.zeros(1 << (LATE_BITS - 3), np.uint8)
    tokens = counts.filter(F.col("count") > least).select("t").toArrow().column("t")
    if len(tokens):
        octet, bit = _bits(tokens.combine_chunks().to_numpy().view(np.uint64))
        np.bitwise_or.at(late, octet, bit)
    return late


def _named(column: str, pairs: DataFrame) -> DataFrame:
    """The ids that written pairs name, as a written table."""
    return cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias(column)).distinct(), "named")


def _among(df: DataFrame, column: str, named: DataFrame) -> DataFrame:
    """Rows whose id is named; the ids are broadcast up to a counted number."""
    return df.join(F.broadcast(named) if named.count() <= BROADCAST_IDS else named, column, "left_semi")


def _possible(pairs: DataFrame, some: DataFrame, percent: int) -> DataFrame:
    """Pairs whose prefixes, given in ``some``, allow the similarity under every order, before any set is built.

    Up to the smaller of the last ranks, both prefixes hold all that their sets hold; what differs there
    differs in the sets. Similar sets differ by (1 - t) / (1 + t) of their sizes' sum at most.
    """
    sides = [
        some.select(F.col("rep").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("n", "p0", "p1")]) for c in "ab"
    ]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    test = F.lit(True)
    for p in ("p0", "p1"):
        ends = [
            F.when(F.size(f"{c}_{p}") < F.col(f"{c}_n"), F.element_at(f"{c}_{p}", -1)).otherwise(F.lit(2**63 - 1))
            for c in "ab"
        ]
        cells = f"filter(a_{p}, x -> x <= l_{p})", f"filter(b_{p}, x -> x <= l_{p})"
        both = both.withColumn(f"l_{p}", F.least(*ends))
        shared = f"size(array_intersect({cells[0]}, {cells[1]}))"
        differs = f"(size({cells[0]}) + size({cells[1]}) - 2 * {shared})"
        test = test & F.expr(
            f"arrays_overlap(a_{p}, b_{p}) and {differs} * {100 + percent} <= (a_n + b_n) * {100 - percent}"
        )
    return both.filter(test).select("a", "b")


def _near(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of class ids whose sketches allow the similarity."""
    numbers = [f"s{i}" for i in range(SKETCH)]
    x, y = (heads.select(F.col("rep").alias(c), F.struct("n", *numbers).alias(to)) for c, to in (("a", "x"), ("b", "y")))
    both = pairs.join(x, "a").join(y, "b")
    return both.filter(_near_sketches("x", "y", percent, SKETCH)).select("a", "b").distinct()


def _verified(
    pairs: DataFrame, heads: DataFrame, described: DataFrame, docs: DataFrame, size: int, percent: int
) -> DataFrame:
    """Written pairs (a, b) of class ids whose sets reach the similarity; text is read for their members only."""
    tried = cut_lineage(_near(pairs, heads, percent), "pairs")
    named = _named("rep", tried)
    some = _among(described.withColumnRenamed("doc_id", "rep"), "rep", named)
    some = some.filter("n > 0").select("rep", "digest", "n", "p0", "p1").dropDuplicates(["rep", "digest"])
    pairs = cut_lineage(_possible(tried, some, percent).distinct(), "possible")
    discard(tried, named)
    named = _named("doc_id", pairs)
    sets = cut_lineage(_sets(_among(docs, "doc_id", named), size), "sets")
    discard(named)
    left = sets.select(F.col("rep").alias("a"), F.col("toks").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("toks").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    found = (
        pairs.join(left, "a").join(right, "b")
        .filter(100 * both >= percent * (F.size("x") + F.size("y") - both))
        .select("a", "b").distinct()
    )
    found = cut_lineage(found, "verified")
    discard(pairs, sets)
    return found


def linked(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (smallest id reachable by links).

    Sets link when 100 * intersection >= percent * union. Null, empty and blank texts have no shingle
    and link with nothing. Repeated rows give repeated, equal rows; a null id takes part in no link.
    Ids are taken to be of one text each: an id with several texts links what any of them links. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    base = texts(docs, id_col, text_col)
    counts = _tokens(base, size, percent).groupBy("t").count().filter(F.col("count") > LATE_COUNT)
    counts = cut_lineage(counts, "frequent")
    shared = spark.sparkContext.broadcast(_late(counts))
    discard(counts)

    described = cut_lineage(_prefixes(base, size, percent, shared), "prefixes")
    usable = described.filter("n > 0 and doc_id is not null")
    numbers = [f"s{i}" for i in range(SKETCH)]
    classes = cut_lineage(
        usable.groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in numbers]),
        "classes",
    )
    heads = classes.select("rep", "n", *numbers)
    # the prefix tokens that several documents have, then those of one document of each class
    entries = usable.select("n", F.posexplode("p0").alias("pos", "t"), F.col("doc_id").alias("rep"))
    side = Window.partitionBy("t").orderBy("rep")
    met = entries.withColumn("p", F.lag("rep").over(side)).withColumn("q", F.lead("rep").over(side))
    met = met.filter("p is not null or q is not null").select("t", "rep", "n", "pos")
    cells = cut_lineage(
        met.join(classes.select("rep", "n").distinct(), ["rep", "n"], "left_semi").distinct(), "cells"
    )
    near = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))
    # at the first token that two sets share, all tokens before it differ: a similar pair meets there at places
    # that add up to no more than similar sets may differ by; a pair that does not, meets nowhere
    early = lambda x, y, i, j: (i + j) * (100 + percent) <= (x + y) * (100 - percent)
    # as many tries as rows: every set with the one its token draws
    drawn = Window.partitionBy("t").orderBy("x", "rep")
    tries = cells.withColumn("x", F.xxhash64("rep", "t"))
    tries = tries.select("rep", "n", "pos", F.first(F.struct(F.col("rep").alias("q"), F.col("n").alias("m"), F.col("pos").alias("j"))).over(drawn).alias("d"))
    tries = (
        tries.select("rep", "n", "pos", "d.q", "d.m", "d.j")
        .filter((F.col("rep") != F.col("q")) & near(F.col("n"), F.col("m")))
        .filter(early(F.col("n"), F.col("m"), F.col("pos"), F.col("j")))
        .select(F.least("rep", "q").alias("a"), F.greatest("rep", "q").alias("b")).distinct()
    )
    stars = _verified(tries, heads, described, base, size, percent)
    joined = cut_lineage(components(stars), "joined")
    # all other pairs, between sets that no verified link joins so far
    grouped = cells.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "g", F.coalesce("root", "rep")
    )
    grouped = cut_lineage(grouped.drop("root"), "grouped")
    mixed = grouped.groupBy("t").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi").select("t")
    rows = grouped.join(mixed, "t").join(heads.select("rep", "n", *_folded()), ["rep", "n"])
    rows = cut_lineage(rows, "mixed")
    discard(joined, grouped, cells)
    x, y = rows.alias("x"), rows.alias("y")
    rest = x.join(
        y,
        (F.col("x.t") == F.col("y.t")) & (F.col("x.rep") < F.col("y.rep"))
        & (F.col("x.g") != F.col("y.g")) & near(F.col("x.n"), F.col("y.n"))
        & early(F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos"))
        & _near_sketches("x", "y", percent, SHORT),
    ).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    others = _verified(rest, heads, described, base, size, percent)
    roots = components(union([stars, others])).withColumnRenamed("node", "rep")
    discard(stars, others, rows)
    roots = classes.join(roots, "rep", "left").select("digest", "n", F.coalesce("root", "rep").alias("c"))
    return described.join(roots, ["digest", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest id of each component; of rows that repeat an id, one stays."""
    gone = linked(docs, size, percent).filter("component_id < doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    null = kept.filter("doc_id is null")
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(null)
