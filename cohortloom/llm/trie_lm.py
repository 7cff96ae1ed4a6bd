"""Word n-gram model in Elias-Fano tries, one per shard of contexts.

Texts become blocks of word numbers with the block's own sorted vocabulary. What a block has to ask or to
count travels packed: its vocabulary in slices of the hash range, which gives counts and numbers common to all
blocks, then its distinct n-grams as a prefix tree. A shard holds all n-grams that begin with the same words.
It adds up the training counts in a trie of ``order`` levels: the words of a level, made rising by what their
parents before them hold, are an Elias-Fano sequence, as are the pointers to the next level; beside them lie
quantised smoothed probabilities and back-off weights, all in memory maps. It answers each block in the block's own
order, so nothing is joined by word.
P(w | h) = p(w | h) + b(h) P(w | h'), h' being h without its first word; p(w | h) = c(h w) / (c(h) + MU) and
b(h) = MU / (c(h) + MU) are what the trie holds; P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).

Pairs that hold over 1 / COMMON of all words are few; the n-grams behind them are cut into slices by their third
word. Every block that has such a pair tells its count to all slices, which thus know the whole context.
"""

from __future__ import annotations

import mmap
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import texts
from cohortloom.llm.jaccard import words
from cohortloom.session import cut_lineage

ORDER = 3
MU = 20.0  # weight of the shorter context against a longer one
LEVELS = 1 << 14  # steps of the quantised log10 probabilities, over 0 .. -LOWEST
LOWEST = 16.0
NUMBER_BITS = 40
HELD_OUT = 1
BLOCK_TOKENS = 1_500_000  # tokens of a block, about; a document is whole
SHARD_WORDS = 1_000_000  # vocabulary entries of all blocks in a shard of words, about
SHARD_GRAMS = 1_000_000  # n-grams of all blocks in a shard of contexts, about
SLICE_GRAMS = 500_000  # tokens behind a slice of a pair, about
COMMON = 10_000  # pairs with more than this share of the tokens are cut into slices: fewer than COMMON pairs


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


_END = _hash(b"\n")  # the edges of a text; no word has white space


def _starts(order: int) -> np.ndarray:
    """What stands before a text, farthest first."""
    return np.array([_hash(b" " * i) for i in range(order - 1, 0, -1)], np.int64)


def mapped(array: np.ndarray) -> np.ndarray:
    """The array in a memory map of its own."""
    if not array.nbytes:
        return array
    held = mmap.mmap(-1, array.nbytes)
    held.write(array.tobytes())
    return np.frombuffer(held, array.dtype)


class EliasFano:
    """A non-decreasing sequence below 2^63: packed high parts in unary, low parts as they are."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        top = int(values[-1]) + 1 if self.n else 1
        self.low_bits = max(0, (top // max(self.n, 1)).bit_length() - 1)
        high = values >> self.low_bits
        bits = np.zeros(self.n + (int(high[-1]) + 1 if self.n else 1), np.uint8)
        bits[high + np.arange(self.n)] = 1
        kind = np.uint16 if self.low_bits <= 16 else np.uint32 if self.low_bits <= 32 else np.uint64
        self.low = mapped((values & ((1 << self.low_bits) - 1)).astype(kind))
        self.high, self.size = mapped(np.packbits(bits)), len(bits)

    def ends(self) -> np.ndarray:
        """Elements before each high part, and behind the last."""
        zeros = np.flatnonzero(np.unpackbits(self.high, count=self.size) == 0)
        return np.concatenate([[0], zeros - np.arange(len(zeros))])

    def get(self, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The values at some positions."""
        high = np.searchsorted(ends, at, "right") - 1
        return (high.astype(np.int64) << self.low_bits) | self.low[at].astype(np.int64)

    def find(self, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Position of each value by a successor search inside its high part; -1 where absent."""
        if not self.n:
            return np.full(len(values), -1)
        high = np.minimum(values >> self.low_bits, len(ends) - 2)
        lo, stop = ends[high], ends[high + 1]
        hi = stop.copy()
        want = (values & ((1 << self.low_bits) - 1)).astype(self.low.dtype)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less = open_ & (self.low[np.minimum(mid, self.n - 1)] < want)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        at = np.minimum(lo, self.n - 1)
        same = (lo < stop) & (values >> self.low_bits == high) & (self.low[at] == want)
        return np.where(same, at, -1)


def quantise(p: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(-np.log10(p), 0, LOWEST) * (LEVELS - 1) / LOWEST).astype(np.uint16)


def restore(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (-q.astype(np.float64) * LOWEST / (LEVELS - 1))


class Level:
    """Words under their parents, parent after parent, with a quantised probability and weight for each."""

    def __init__(self, parent: np.ndarray, word: np.ndarray, parents: int, p: np.ndarray, weight: np.ndarray) -> None:
        ends = np.searchsorted(parent, np.arange(parents + 1))
        self.pointers = EliasFano(ends)
        last = np.where(np.diff(ends) > 0, word[ends[1:] - 1] + 1, 0) if len(word) else np.zeros(parents, np.int64)
        self.words = EliasFano((np.cumsum(last) - last)[parent] + word)
        self.values, self.weights = mapped(quantise(p)), mapped(quantise(weight))
        self.word_ends, self.pointer_ends = self.words.ends(), self.pointers.ends()

    def find(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of a word under each parent, -1 where either is absent."""
        if not self.words.n:
            return np.full(len(word), -1)
        known = parent >= 0
        own = np.maximum(parent, 0)
        first, stop = (self.pointers.get(own + i, self.pointer_ends) for i in range(2))
        base = np.where(first > 0, self.words.get(np.maximum(first - 1, 0), self.word_ends) + 1, 0)
        at = self.words.find(base + word, self.word_ends)
        return np.where(known & (at >= first) & (at < stop), at, -1)


class Trie:
    """Levels of n-grams from sorted prefix trees: per level the parents, words and counts of its nodes.

    ``single`` holds the count of each word of the first level as a context, in the whole corpus.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], single: np.ndarray) -> None:
        self.levels, above, below = [], np.zeros(1, np.int64), single
        for depth, (parent, word, count) in enumerate(levels):
            # nodes without training text are left out; what is kept is numbered anew
            keep = np.flatnonzero(count > 0)
            number = np.cumsum(count > 0) - 1
            parents = int((above >= 0).sum())
            own = above[parent[keep]]
            c = count[keep] if depth else single[keep]
            p = np.ones(len(keep)) if not depth else count[keep] / (below[parent[keep]] + MU)
            self.levels.append(Level(own, word[keep], parents if len(keep) else 0, p, MU / (c + MU)))
            above, below = np.where(count > 0, number, -1), count if depth else single

    def look_up(self, nodes: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """1 + quantised probability and weight, 0 where unknown, of (parent, word) nodes from the second level on."""
        at, out = np.zeros(1, np.int64), []
        for depth, (level, (parent, word)) in enumerate(zip(self.levels, nodes)):
            at = level.find(at[parent], word)
            if depth:  # no context is longer than those of the last level
                last = depth + 1 == len(self.levels)
                out.append((_known(level.values, at), np.zeros(len(at), np.uint16) if last else _known(level.weights, at)))
        return out


def _known(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(at), np.uint16)
    return np.where(at >= 0, values[np.maximum(at, 0)] + 1, 0).astype(np.uint16)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as byte planes, compressed together."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for kind, width in zip(kinds, widths):
        plane = raw[at : at + n * width].reshape(width, n)
        out.append(np.ascontiguousarray(plane.T).view(kind).reshape(-1))
        at += n * width
    return out


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == HELD_OUT


_hashes: dict[bytes, int] = {}


def _numbers(text: bytes | None) -> np.ndarray:
    found = words(text)
    if len(_hashes) > 400_000:
        _hashes.clear()
    for w in set(found).difference(_hashes):
        _hashes[w] = _hash(w)
    return np.array([*map(_hashes.__getitem__, found), _END], np.int64)


_BLOCK = (
    "block long, doc_ids array<long>, sizes array<int>, n_tokens long, n_vocab long, vocab binary, ids binary, "
    "pairs array<struct<v: long, w: long, n: long>>"
)


def _frequent_pairs(vocab: np.ndarray, ids: np.ndarray) -> list[dict]:
    """Pairs with more than 1 / COMMON of a block's tokens; both of their words have that share too."""
    least = len(ids) / COMMON
    often = np.bincount(ids, minlength=len(vocab)) > least
    at = np.flatnonzero(often[ids[:-1]] & often[ids[1:]])
    pairs, n = np.unique(ids[at].astype(np.int64) * len(vocab) + ids[at + 1], return_counts=True)
    keep = n > least
    v, w = np.divmod(pairs[keep], len(vocab))
    return [{"v": a, "w": b, "n": c} for a, b, c in zip(vocab[v].tolist(), vocab[w].tolist(), n[keep].tolist())]


def _blocks(parts: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: sorted vocabulary with training counts, and each token's place in it."""
    block, docs, held, size = TaskContext.get().partitionId() << 32, [], [], 0

    def close() -> pa.RecordBatch:
        tokens = np.concatenate(held)
        sizes = np.array([len(h) for h in held])
        vocab, ids = np.unique(np.append(tokens, _starts(order)), return_inverse=True)
        ids = ids[: len(tokens)]
        train = np.repeat(np.array([not held_out(d) for d in docs]), sizes)
        counts = np.bincount(ids[train], minlength=len(vocab))
        columns = [[block], [docs], [sizes], [len(tokens)], [len(vocab)],
                   [_packed(vocab, counts)], [_packed(ids.astype(np.uint32))], [_frequent_pairs(vocab, ids)]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary(), pa.binary(),
                 pa.list_(pa.struct([(x, pa.int64()) for x in "vwn"]))]
        names = ["block", "doc_ids", "sizes", "n_tokens", "n_vocab", "vocab", "ids", "pairs"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in parts:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                docs.append(doc)
                held.append(_numbers(text))
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield close()
                    block, docs, held, size = block + 1, [], [], 0
    if held:
        yield close()
    _hashes.clear()  # a worker goes on to other stages, which need its memory
    pa.default_memory_pool().release_unused()


def _part(vocab: np.ndarray, shards: int) -> np.ndarray:
    """First place of each of ``shards`` equal ranges of hashes, and the end."""
    edges = [(i << 63) // shards for i in range(shards)]
    return np.append(np.searchsorted(vocab, np.array(edges, np.int64)), len(vocab))


_PACK = "shard long, block long, data binary"


def _rows(rows: list[tuple], schema: str = _PACK) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [name for name, _ in fields]
    )


def _grams_of(block: dict, order: int):
    """Prefix tree of a block's n-grams: (vocabulary, first node of each text, levels of (parent, word, counts, node)).

    Nodes of a level are sorted by parent and word, in local numbers; ``node`` is that of the n-gram at each place
    where one begins. Texts stand between ``order - 1`` starts and ``order - 2`` places of no word.
    """
    vocab = _unpacked(block["vocab"], "<i8", "<i8")[0]
    w = _unpacked(block["ids"], "<u4")[0].astype(np.int32)
    sizes = np.array(block["sizes"], np.int64)
    lead, tail = order - 1, order - 2
    begins = np.cumsum(sizes) - sizes
    first = begins + np.arange(len(sizes)) * (lead + tail)
    line = np.full(len(w) + len(sizes) * (lead + tail), len(vocab), np.int32)
    for i, start in enumerate(np.searchsorted(vocab, _starts(order))):
        line[first + i] = start
    line[np.arange(len(w)) + np.repeat(first + lead - begins, sizes)] = w
    held = sizes + tail  # n-grams of a text
    places = np.arange(held.sum()) + np.repeat(first - (np.cumsum(held) - held), held)
    train = np.repeat(np.array([not held_out(d) for d in block["doc_ids"]]), held)
    base, node, levels = len(vocab) + 1, line[places], []
    for k in range(1, order):
        codes, node = np.unique(node.astype(np.int64) * base + line[places + k], return_inverse=True)
        node = node.astype(np.int32)
        parent, word = (x.astype(np.int32) for x in np.divmod(codes, base))
        levels.append((parent, word, np.bincount(node[train], minlength=len(codes)).astype(np.uint32), node))
    return vocab, np.cumsum(held) - held, levels


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _dealt(vocab: np.ndarray, single: np.ndarray, levels: list, ways: list[np.ndarray], shards: int) -> list[tuple]:
    """Per level from pairs on (shards in order, node): a pair goes to the shards of all of its slices.

    ``ways``: first words, second words and slices of the pairs that have several, if there are any. A longer n-gram goes to one slice of its pair, with all n-grams that it begins.
    """
    names = np.append(vocab, 0).astype(np.uint64)  # behind an end there is no word
    parent, word, _, _ = levels[0]
    cuts = (single // SLICE_GRAMS + 1).astype(np.uint64)  # a frequent first word is cut by the second
    key = _mixed(names[parent] * np.uint64(0x9E3779B97F4A7C15) + _mixed(names[word]) % cuts[parent])
    slices = np.ones(len(parent), np.int64)
    if len(ways) and len(levels) > 1:
        v, w, n = ways
        x, y = (np.minimum(np.searchsorted(vocab, z), len(vocab) - 1) for z in (v, w))
        codes, here = parent.astype(np.int64) * len(names) + word, (vocab[x] == v) & (vocab[y] == w)
        at = np.minimum(np.searchsorted(codes, x * len(names) + y), len(codes) - 1)
        here &= codes[at] == x * len(names) + y
        slices[at[here]] = n[here]
    shard_of = lambda k, part: (_mixed(k + part.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
    pair = np.repeat(np.arange(len(parent)), slices)
    part = np.arange(len(pair)) - np.repeat(np.cumsum(slices) - slices, slices)
    shard = shard_of(key[pair], part)
    if len(pair) > len(parent):  # two slices of a pair may share a shard, which is told of it once
        shard, pair = np.divmod(np.unique(shard * len(parent) + pair), len(parent))
    order = np.argsort(shard, kind="stable")
    out = [(shard[order], pair[order])]
    for depth, (parent, word, _, _) in enumerate(levels[1:]):
        if not depth:
            part = (_mixed(names[word]) % slices[parent].astype(np.uint64)).astype(np.int64)
            shard = shard_of(key[parent], part)
        else:
            shard = shard[parent]
        order = np.argsort(shard, kind="stable")
        out.append((shard[order], order))
    return out


def _question(levels: list, taken: list[np.ndarray], numbers: np.ndarray, single: np.ndarray) -> bytes:
    """The nodes of a shard: first words with their counts and number of pairs, then level by level."""
    above, words, counts = levels[0][0][taken[0]], levels[0][1][taken[0]], levels[0][2][taken[0]]
    head = np.flatnonzero(np.diff(above, prepend=-1))
    parts = [_packed(numbers[above[head]], single[above[head]], np.diff(np.append(head, len(above))))]
    for depth, nodes in enumerate(taken):
        words, counts = levels[depth][1][nodes], levels[depth][2][nodes]
        if depth + 1 < len(taken):
            below = levels[depth + 1][0][taken[depth + 1]]
            children = np.searchsorted(below, nodes, "right") - np.searchsorted(below, nodes)
        else:
            children = np.zeros(len(nodes), np.int64)
        number = np.ascontiguousarray(numbers[words]).view(np.uint8).reshape(-1, 8)
        parts.append(_packed(np.ascontiguousarray(number[:, :5]), counts.astype(np.uint32), children.astype(np.uint32)))
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """First words, their counts, and (parent, word, count) of each level from pairs on."""
    parts, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        parts.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    first, single, times = _unpacked(parts[0], "<i8", "<i8", "<i8")
    levels = []
    for part in parts[1:]:
        number, counts, children = _unpacked(part, "V5", "<u4", "<u4")
        wide = np.zeros((len(number), 8), np.uint8)
        wide[:, :5] = number.view(np.uint8).reshape(-1, 5)
        levels.append((np.repeat(np.arange(len(times), dtype=np.int32), times), wide.view("<i8").reshape(-1), counts))
        times = children
    return first, single, levels


def _seen_once(weight: np.ndarray) -> np.ndarray:
    """Quantised probability of what a context of that quantised weight has seen once: MU / (c + MU) over MU."""
    return quantise(restore(weight) / MU).astype(np.int32)


def _answers(asked: list) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each block what one trie of all blocks' counts says of its nodes: (probabilities, weights) by level.

    Weights are 1 + the quantised one, probabilities 2 + their steps above that of an n-gram seen once; 0: unknown.
    """
    first, place = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    single = np.zeros(len(first), np.int64)
    single[place] = np.concatenate([a[1] for a in asked])
    ends = np.cumsum([0, *(len(a[0]) for a in asked)])
    nodes, levels, wheres = [(np.zeros(len(first), np.int64), first)], [], []
    for k in range(len(asked[0][2])):
        up = np.concatenate([a[2][k][0] + np.int32(e) for a, e in zip(asked, ends)])
        codes = (place[up].astype(np.int64) << NUMBER_BITS) | np.concatenate([a[2][k][1] for a in asked])
        codes, place = np.unique(codes, return_inverse=True)
        place = place.astype(np.int32)
        counts = np.bincount(place, np.concatenate([a[2][k][2] for a in asked]), len(codes)).astype(np.int64)
        nodes.append((codes >> NUMBER_BITS, codes & ((1 << NUMBER_BITS) - 1)))
        levels.append((*nodes[-1], counts))
        ends = np.cumsum([0, *(len(a[2][k][0]) for a in asked)])
        for a in asked:
            a[2][k] = a[2][k][:1]  # words and counts are done with
        wheres.append((place, ends))
    used = np.bincount(levels[0][0], levels[0][2], len(first)).astype(np.int64)
    found = Trie([(*nodes[0], used), *levels], single).look_up(nodes)
    above, told = quantise(MU / (single + MU)), []
    for (p, weight), (parent, _, _) in zip(found, levels):
        told.append((np.where(p > 0, _seen_once(above)[parent] + 3 - p, 0).astype(np.uint16), weight))
        above = np.maximum(weight, 1) - 1
    found = told
    return [
        [(p[place[e[i] : e[i + 1]]], b[place[e[i] : e[i + 1]]]) for (p, b), (place, e) in zip(found, wheres)]
        for i in range(len(asked))
    ]


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model looks at ``order - 1`` words before each, 1 at least. Null and empty texts are one end token.
    Repeated rows each count and each get their row. A null id counts by the text "None". Without training
    text every token is unknown. Other columns are ignored.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    cut = texts(docs, id_col, text_col).mapInArrow(lambda parts: _blocks(parts, order), _BLOCK)
    blocks = cut_lineage(cut, "lm-blocks")
    sums = blocks.agg(F.sum("n_tokens"), F.sum("n_vocab"), F.sum(F.size("doc_ids"))).first()
    tokens, entries, n_docs = (int(x or 0) for x in sums)
    word_shards, shards = max(1, -(-entries // SHARD_WORDS)), max(1, -(-tokens // SHARD_GRAMS))
    often = blocks.select(F.inline("pairs")).groupBy("v", "w").agg(F.sum("n").alias("n"))
    often = often.filter(F.col("n") > max(SLICE_GRAMS, tokens / COMMON)).collect()  # fewer than COMMON
    near = int(_starts(order)[-1])  # what follows an end in a block begins a text
    ways = [(near if r["v"] == _END else r["v"], r["w"], -(-r["n"] // SLICE_GRAMS)) for r in often]
    if order > 2 and n_docs > SLICE_GRAMS:
        ways.append((int(_starts(order)[-2]), near, -(-n_docs // SLICE_GRAMS)))
    ways = list(np.array(ways, np.int64).T)

    def ask_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                vocab, counts = _unpacked(data, "<i8", "<i8")
                at = _part(vocab, word_shards).tolist()
                rows = [(s, block, _packed(vocab[a:b], counts[a:b])) for s, (a, b) in enumerate(zip(at, at[1:])) if a < b]
                yield _rows(rows)

    def count_words(group: pa.Table) -> pa.Table:
        asked = [_unpacked(d, "<i8", "<i8") for d in group.column("data").to_pylist()]
        vocab, place = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([a[1] for a in asked]), len(vocab)).astype(np.int64)
        rank = np.empty(len(vocab), np.int64)  # small numbers of frequent words travel in fewer bytes
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(vocab))
        ends = np.cumsum([0, *(len(a[0]) for a in asked)]).tolist()
        shard = group.column("shard")[0].as_py()
        rows = [
            (shard, block, _packed(counts[place[a:b]], rank[place[a:b]]), 0, 0, 0)
            for block, a, b in zip(group.column("block").to_pylist(), ends, ends[1:])
        ]
        rows.append((shard, -1, b"", int(counts.sum()), int((counts > 0).sum()), len(vocab)))
        return pa.Table.from_batches([_rows(rows, answer)])

    answer = _PACK + ", total long, kinds long, words long"
    known = cut_lineage(
        blocks.select("block", "vocab").mapInArrow(ask_words, _PACK).groupBy("shard").applyInArrow(count_words, answer),
        "lm-words",
    )
    sums = known.filter("block = -1").agg(F.sum("total"), F.sum("kinds"), F.max("words")).first()
    total, kinds, ranks = (int(x or 0) for x in sums)

    def counted(block: dict, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its training count, its count as a context and its number among all words."""
        told = sorted(((x["shard"], x["data"]) for x in block["words"]), key=lambda x: x[0])
        told = [(s, *_unpacked(d, "<i8", "<i8")) for s, d in told]
        c = np.concatenate([t[1] for t in told])
        number = np.concatenate([t[2] * word_shards + t[0] for t in told])
        of = c.copy()
        of[np.searchsorted(vocab, _starts(order))] = c[np.searchsorted(vocab, _END)]  # one of each in a text
        return c, of, np.append(number, ranks * word_shards)

    def ask_grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                vocab, _, levels = _grams_of(block, order)
                _, of, numbers = counted(block, vocab)
                dealt = _dealt(vocab, of, levels, ways, shards)
                edges = [np.searchsorted(shard, np.arange(shards + 1)).tolist() for shard, _ in dealt]
                for s in range(shards):
                    taken = [nodes[e[s] : e[s + 1]] for (_, nodes), e in zip(dealt, edges)]
                    if len(taken[0]):
                        yield _rows([(s, block["block"], _question(levels, taken, numbers, of))])

    def look_up(group: pa.Table) -> pa.Table:
        answers = _answers([_read(d) for d in group.column("data").to_pylist()])
        shard = group.column("shard")[0].as_py()
        return pa.Table.from_batches([_rows([
            (shard, block, _packed(*[np.concatenate([x[i] for x in said]) for i in range(2)]))
            for block, said in zip(group.column("block").to_pylist(), answers)
        ])])

    cell = F.collect_list(F.struct("shard", "data"))  # packed answers to one block
    by_words = known.filter("block >= 0").groupBy("block").agg(cell.alias("words"))
    both = blocks.join(by_words, "block").select("block", "doc_ids", "sizes", "vocab", "ids", "words")
    looked = both.mapInArrow(ask_grams, _PACK).groupBy("shard").applyInArrow(look_up, _PACK)

    def sum_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                vocab, begins, levels = _grams_of(block, order)
                c, of, _ = counted(block, vocab)
                dealt = _dealt(vocab, of, levels, ways, shards)
                said = [np.zeros((2, len(x[0])), np.uint16) for x in levels]  # probability and weight of each node
                edges = [np.searchsorted(shard, np.arange(shards + 1)).tolist() for shard, _ in dealt]
                for x in block["grams"]:
                    values, at = np.stack(_unpacked(x["data"], "<u2", "<u2")), 0
                    for own, (_, nodes), e in zip(said, dealt, edges):
                        a, b = e[x["shard"]], e[x["shard"] + 1]
                        own[:, nodes[a:b]] = values[:, at : at + b - a]
                        at += b - a
                del dealt, edges
                w = _unpacked(block["ids"], "<u4")[0].astype(np.int64)
                first = np.cumsum(block["sizes"]) - block["sizes"]
                spot = np.arange(len(w)) + np.repeat(begins + order - 1 - first, block["sizes"])
                one = (c + 0.5) / (total + 0.5 * (kinds + 1))
                p, weight = one[w], MU / (of + MU)
                above = quantise(weight)
                for k, (own, (parent, _, _, node)) in enumerate(zip(said, levels)):
                    at = node[spot - k - 1]  # the n-gram that ends at each word
                    held = np.where(own[0] > 0, restore(_seen_once(above)[parent] + 2 - own[0]), 0.0)
                    p = held[at] + weight[parent[at]] * p
                    above = np.maximum(own[1], 1) - 1
                    weight = np.where(own[1] > 0, restore(above), 1.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block["doc_ids"], pa.int64()),
                        pa.array([held_out(d) for d in block["doc_ids"]], pa.bool_()),
                        pa.array(block["sizes"], pa.int64()),
                        pa.array(np.add.reduceat((c[w] > 0).astype(np.int64), first)),
                        pa.array([total] * len(first), pa.int64()),
                        pa.array(np.add.reduceat(np.log10(one)[w], first)),
                        pa.array(np.add.reduceat(np.log10(p), first)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    by_grams = looked.groupBy("block").agg(cell.alias("grams"))
    return (
        both.join(by_grams, "block")
        .select("block", "doc_ids", "sizes", "vocab", "ids", "words", "grams")
        .mapInArrow(
            sum_up,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
            "base_score double, score double",
        )
    )
