"""Shortest-pack-first packing over the histogram of document lengths.

Documents are cut into full sequences and a rest. The rests are packed as a histogram: longest length
first, each into the open pack with most room, in steps of equal packs, so the work depends on the number
of lengths and not of documents. Packs that stay short are then dissolved into the room of others. The
plan says which ranks of a length go where; rests find their row by length and rank.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import texts
from cohortloom.llm.token_ids import TokenIds, batches, default_vocabulary
from cohortloom.session import cut_lineage

CAPACITY = 2048
END_ID = 1


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Rows (length, rank_lo, rank_hi, start, size, sequence, offset) and the number of sequences.

    Rank r of a length, rank_lo <= r < rank_hi, puts its ids [start, start + size) at ``offset`` of
    sequence ``sequence + r - rank_lo``.
    """
    groups: list[dict] = []  # packs alike: first sequence, count, filled, slots
    opened = 0
    by_fill: dict[int, list[dict]] = {}
    for length in sorted((x for x in histogram if 0 < x < capacity), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            fill = min((f for f, g in by_fill.items() if g), default=capacity)
            if fill + length > capacity:
                group = {"seq": opened, "n": left, "fill": 0, "slots": []}
                opened += left
            else:
                group = by_fill[fill].pop()
                if group["n"] > left:
                    rest = {
                        **group,
                        "seq": group["seq"] + left,
                        "n": group["n"] - left,
                        "slots": [(a, b + left, c, d) for a, b, c, d in group["slots"]],
                    }
                    by_fill[fill].append(rest)
                    group["n"] = left
            group["slots"] = [*group["slots"], (length, rank, group["fill"], length)]
            group["fill"] += length
            rank += group["n"]
            left -= group["n"]
            by_fill.setdefault(group["fill"], []).append(group)
    groups = [g for part in by_fill.values() for g in part]
    rows: list[tuple] = []
    # dissolve the shortest packs into the room of the fullest
    groups.sort(key=lambda g: (-g["fill"], g["seq"]))
    emptied: list[tuple[int, int]] = []
    for group in groups:
        group["used"] = 0
    spare: deque[list[int]] = deque()  # rooms being filled: first sequence, count, filled
    lo, hi = 0, len(groups) - 1
    while lo <= hi:
        source = groups[hi]
        room = sum(n * (capacity - f) for _, n, f in spare)
        room += sum((g["n"] - g["used"]) * (capacity - g["fill"]) for g in groups[lo:hi])
        free = source["n"] - source["used"]
        n = min(free, room // source["fill"])
        if n < free:  # of packs alike some can go into the others
            n = (room + free * (capacity - source["fill"])) // capacity
        if n <= 0:
            break
        base = source["n"] - n
        jobs = [(0, n, 0)]  # packs [first, last) of the source have placed ``done`` of their content
        while jobs:
            first, last, done = jobs.pop()
            while not spare:
                target, end = groups[lo], base if lo == hi else groups[lo]["n"]
                count = min(end - target["used"], last - first)  # the others may be dissolved later
                if count <= 0 or target["fill"] >= capacity:
                    lo += 1
                    continue
                spare.append([target["seq"] + target["used"], count, target["fill"]])
                target["used"] += count
            seq, count, fill = spare.popleft()
            take = min(count, last - first)
            size = min(capacity - fill, source["fill"] - done)
            for length, rank, offset, span in source["slots"]:
                x, y = max(offset, done), min(offset + span, done + size)
                if x < y:
                    low = rank + base + first
                    rows.append((length, low, low + take, x - offset, y - x, seq, fill + x - done))
            if take < count:
                spare.appendleft([seq + take, count - take, fill])
            if fill + size < capacity:
                spare.appendleft([seq, take, fill + size])
            if take < last - first:
                jobs.append((first + take, last, done))
            if done + size < source["fill"]:
                jobs.append((first, first + take, done + size))
        emptied.append((source["seq"] + base, n))
        source["n"] = base
        if n < free:
            break
        hi -= 1
    for group in groups:
        if group["n"]:
            rows += [
                (length, rank, rank + group["n"], 0, span, group["seq"], offset)
                for length, rank, offset, span in group["slots"]
            ]
    # close the gaps that emptied packs leave in the numbering; a row never spans one
    emptied.sort()
    starts = np.array([s for s, _ in emptied], np.int64)
    gone = np.concatenate([[0], np.cumsum([n for _, n in emptied])]).astype(np.int64)
    closed = []
    for length, a, b, start, size, seq, offset in rows:
        closed.append((length, a, b, start, size, int(seq - gone[np.searchsorted(starts, seq, "right")]), offset))
    return closed, int(opened - gone[-1])


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Null text is empty and packs its end id alone. Repeated rows are packed each. Pieces of a document
    that fill a sequence are numbered after all packed rests. An empty table has no pieces.
    """
    path = vocabulary or default_vocabulary()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder = TaskContext.get().partitionId(), TokenIds.of(path)
        seen, fulls = np.zeros(capacity, np.int64), 0
        for batch in parts:
            ids_of, values = batch.column(0), batch.column(1).to_pylist()
            for a, b in batches(values):
                flat, sizes = coder.encode(values[a:b])
                ends = np.cumsum(sizes)
                blobs, local, before = [], [], []
                for x, y in zip(ends - sizes, ends):
                    n = int(y - x) + 1
                    blobs.append(np.append(flat[x:y], np.uint32(end_id)).astype("<u4").tobytes())
                    rest = n % capacity
                    local.append(int(seen[rest]))
                    before.append(fulls)
                    seen[rest] += 1
                    fulls += n // capacity
                yield pa.RecordBatch.from_arrays(
                    [
                        ids_of.slice(a, b - a),
                        pa.array([part] * (b - a), pa.int32()),
                        pa.array(sizes + 1, pa.int64()),
                        pa.array(local, pa.int64()),
                        pa.array(before, pa.int64()),
                        pa.array(blobs, pa.binary()),
                    ],
                    ["doc_id", "part", "n", "local", "fulls", "ids"],
                )
        coder.forget()

    encoded = cut_lineage(
        texts(docs, id_col, text_col).mapInArrow(
            encode, "doc_id long, part int, n long, local long, fulls long, ids binary"
        ),
        "encoded",
    )
    rest = (F.col("n") % capacity).cast("int")
    per_part = cut_lineage(
        encoded.groupBy("part", rest.alias("rest")).agg(
            F.count("*").alias("count"), F.sum(F.floor(F.col("n") / capacity)).alias("fulls")
        ),
        "lengths",
    )
    counts = {
        r["rest"]: r["count"] for r in per_part.groupBy("rest").agg(F.sum("count").alias("count")).collect()
    }  # at most ``capacity`` rows
    placed, packed = plan(counts, capacity)
    table = np.array(sorted(placed), np.int64).reshape(-1, 7)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    # ranks before each part, per length; full sequences before each part
    order = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select(
        "part", "rest", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("base")
    ).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("rest", "base"))).alias("bases"))
    totals = per_part.groupBy("part").agg(F.sum("fulls").alias("f"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    totals = totals.select("part", F.coalesce(F.sum("f").over(ahead), F.lit(0)).alias("fulls_before"))
    heads = cut_lineage(bases.join(totals, "part"), "part-bases")
    ranked = encoded.join(heads, "part").select(
        "doc_id",
        "n",
        (F.col("bases")[rest] + F.col("local")).alias("rank"),
        (F.col("fulls_before") + F.col("fulls")).alias("full_at"),
        "ids",
    )

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        first = np.searchsorted(rows[:, 0], np.arange(capacity + 1))
        ranks_of = {}
        for batch in parts:
            out: list[list] = [[] for _ in range(8)]
            for doc, n, rank, full, blob in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                rest_n, spans = n % capacity, []
                whole = n // capacity
                spans = [(i * capacity, capacity, packed + full + i, 0) for i in range(whole)]
                if rest_n:
                    if rest_n not in ranks_of:
                        own = rows[first[rest_n] : first[rest_n + 1]]
                        marks = np.unique(own[:, 1:3])
                        ranks_of[rest_n] = (own, marks, {})
                    own, marks, memo = ranks_of[rest_n]
                    slot = int(np.searchsorted(marks, rank, "right"))
                    if slot not in memo:
                        memo[slot] = own[(own[:, 1] <= rank) & (rank < own[:, 2])]
                    spans += [
                        (whole * capacity + int(r[3]), int(r[4]), int(r[5] + rank - r[1]), int(r[6]))
                        for r in memo[slot]
                    ]
                for start, size, seq, offset in spans:
                    piece = blob[4 * start : 4 * (start + size)]
                    for column, value in zip(
                        out, (doc, start, size, zlib.crc32(piece), n, seq, offset, piece)
                    ):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out[:7]] + [pa.array(out[7], pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return ranked.mapInArrow(
        cut,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long, ids binary",
    )
