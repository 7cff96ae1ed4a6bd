"""Token ids in a file of shuffled bytes.

A file image holds consecutive documents. Their ids, one after the other, are cut into chunks of
``CHUNK`` ids; a chunk is transposed into four byte planes, each compressed with zstandard. Layout, all
little-endian: magic (4 bytes), number of chunks, ids in all (uint32, uint64); per chunk its ids and the
compressed size of each plane (5 x uint32); then the planes. Images are rows of a written table, so an
image appears whole or not at all when executors are lost.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import texts
from cohortloom.llm.token_ids import TokenIds, batches, default_vocabulary
from cohortloom.session import fresh_path

CHUNK = 1 << 16
FILE_IDS = 1 << 20  # an image is closed once it holds so many ids
END_ID = 2
MAGIC = b"BPL1"
SCHEMA = "shard int, image int, first long, n_ids long, doc_ids array<long>, sizes array<long>, data binary"


def pack_ids(ids: np.ndarray, chunk: int = CHUNK, level: int = 3) -> bytes:
    """File image of an array of ids."""
    codec = zstandard.ZstdCompressor(level=level)
    index, body = [], []
    for a in range(0, len(ids), chunk):
        part = np.ascontiguousarray(ids[a : a + chunk], "<u4")
        planes = part.view(np.uint8).reshape(-1, 4).T
        squeezed = [codec.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
        index.append(struct.pack("<5I", len(part), *map(len, squeezed)))
        body += squeezed
    return b"".join([MAGIC, struct.pack("<IQ", len(index), len(ids)), *index, *body])


def unpack_ids(data: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """Ids [first, first + count) of an image; chunks outside that range are skipped by the index."""
    if data[:4] != MAGIC:
        raise ValueError("not an image of token ids")
    chunks, total = struct.unpack_from("<IQ", data, 4)
    end = total if count is None else min(total, first + count)
    codec, at, pos, out = zstandard.ZstdDecompressor(), 16 + 20 * chunks, 0, []
    for c in range(chunks):
        n, *sizes = struct.unpack_from("<5I", data, 16 + 20 * c)
        if pos < end and pos + n > first:
            planes, p = np.empty((4, n), np.uint8), at
            for k, size in enumerate(sizes):
                planes[k] = np.frombuffer(codec.decompress(data[p : p + size], max_output_size=n), np.uint8)
                p += size
            ids = np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
            out.append(ids[max(first - pos, 0) : min(end - pos, n)])
        at, pos = at + sum(sizes), pos + n
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_ids(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode whole texts in ascending order of id and write their images below ``path``.

    Null text is empty: its end id alone. Repeated ids stand next to each other, ordered by text; null
    ids come first. The one shuffle moves the texts into ranges of ids.
    """
    vocabulary = vocabulary or default_vocabulary()

    def images(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, coder = TaskContext.get().partitionId(), TokenIds.of(vocabulary)
        held: list[np.ndarray] = []
        docs_held: list = []
        sizes_held: list[int] = []
        image, first, count = 0, 0, 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([image], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.array([count], pa.int64()),
                    pa.array([docs_held], pa.list_(pa.int64())),
                    pa.array([sizes_held], pa.list_(pa.int64())),
                    pa.array([pack_ids(np.concatenate(held))], pa.binary()),
                ],
                ["shard", "image", "first", "n_ids", "doc_ids", "sizes", "data"],
            )

        for batch in parts:
            names, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches(values):
                flat, sizes = coder.encode(values[a:b])
                ends = np.cumsum(sizes)
                for name, x, y in zip(names[a:b], ends - sizes, ends):
                    held.append(np.append(flat[x:y], np.uint32(end_id)))
                    docs_held.append(name)
                    sizes_held.append(int(y - x) + 1)
                    count += sizes_held[-1]
                    if count >= FILE_IDS:
                        yield close()
                        image, first, count = image + 1, first + count, 0
                        held, docs_held, sizes_held = [], [], []
        coder.forget()
        if held:
            yield close()

    base = texts(docs, id_col, text_col)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = base.repartitionByRange(tasks, F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(images, SCHEMA).write.parquet(path)


def read_ids(spark, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per write task
    totals = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))

    def digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for begin, names, sizes, data in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                ids, ends = unpack_ids(data), np.cumsum(sizes)
                starts = ends - np.array(sizes)
                crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(starts + begin, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = files.join(totals, "shard").select(
        (F.col("ahead") + F.col("first")).alias("begin"), "doc_ids", "sizes", "data"
    )
    return placed.mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the files to a fresh place in the shared folder and read them back."""
    path = fresh_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, vocabulary)
    return read_ids(docs.sparkSession, path)
