"""Web archives in ZIP packages: WARC records written per page and read back by ranges, without extraction.

A package is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` holds one gzip
member per record, ``indexes/index.jsonl`` one line per record with its place therein. The reader asks for
ranges only: the end of the file for the directory record (and its ZIP64 form), the central directory, the
local header of a member, the index, then each record where the index says. It works on bytes in memory and
on open files alike.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import cut_lineage, fresh_path

# Names of the members of a package.
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"

# Signatures and layouts of the ZIP format.
_END, _END64, _LOCATOR64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_CENTRAL, _LOCAL = b"PK\x01\x02", b"PK\x03\x04"
_END_SIZE, _LOCATOR64_SIZE, _END64_SIZE, _CENTRAL_SIZE, _LOCAL_SIZE = 22, 20, 56, 46, 30
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF

# Bytes of compressed records after which a package is closed; a longer record has one of its own.
PACKAGE_BYTES = 4_000_000
_LEVEL = 4  # of gzip

# All records carry the same date, so that a package depends on its pages alone.
DATE = "2000-01-01T00:00:00Z"

PACKAGES = "package string, image binary"
RECORDS = (
    "package string, page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)


class ArchiveError(ValueError):
    """A package that is not what its directory, index or digests say."""


Read = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Member:
    """A file within a package, as the central directory tells it."""

    name: str
    method: int
    size: int
    stored: int
    header: int


class Package:
    """A ZIP file behind a function that reads ``length`` bytes from ``start``."""

    def __init__(self, read: Read, size: int) -> None:
        self._read, self.size = read, size
        self.members = {m.name: m for m in self._directory()}
        self._begin: dict[str, int] = {}

    @classmethod
    def of_bytes(cls, image: bytes) -> Package:
        view = memoryview(image)
        return cls(lambda start, length: bytes(view[start : start + length]), len(image))

    @classmethod
    def of_file(cls, file: io.BufferedIOBase) -> Package:
        def read(start: int, length: int) -> bytes:
            file.seek(start)
            return file.read(length)

        return cls(read, file.seek(0, os.SEEK_END))

    def _exactly(self, start: int, length: int) -> bytes:
        data = self._read(start, length) if 0 <= start and start + length <= self.size else b""
        if len(data) != length:
            raise ArchiveError(f"{length} bytes at {start} reach beyond the file of {self.size}")
        return data

    def _end(self) -> tuple[int, int, int]:
        """Number of members, size and start of the central directory."""
        tail = self._exactly(max(self.size - _END_SIZE - _FULL16, 0), min(self.size, _END_SIZE + _FULL16))
        at = tail.rfind(_END)
        while at >= 0:  # a comment may hold the signature as well
            if len(tail) - at >= _END_SIZE:
                count, size, start, comment = struct.unpack_from("<10xHIIH", tail, at)
                if at + _END_SIZE + comment == len(tail):
                    break
            at = tail.rfind(_END, 0, at)
        else:
            raise ArchiveError("no end of a central directory")
        if count != _FULL16 and size != _FULL32 and start != _FULL32:
            return count, size, start
        place = self.size - len(tail) + at - _LOCATOR64_SIZE
        locator = self._exactly(place, _LOCATOR64_SIZE) if place >= 0 else b""
        if locator[:4] != _LOCATOR64:
            return count, size, start  # exactly these numbers, in a plain file
        record = self._exactly(struct.unpack_from("<8xQ", locator)[0], _END64_SIZE)
        if record[:4] != _END64:
            raise ArchiveError("the ZIP64 locator points at something else")
        return struct.unpack_from("<32xQQQ", record)

    def _directory(self) -> Iterator[Member]:
        count, size, start = self._end()
        data, at = self._exactly(start, size), 0
        for _ in range(count):
            if data[at : at + 4] != _CENTRAL or at + _CENTRAL_SIZE > size:
                raise ArchiveError("the central directory is broken")
            flags, method, stored, full, name_n, extra_n, note_n, header = struct.unpack_from(
                "<8xHH8xIIHHH8xI", data, at
            )
            name = data[at + _CENTRAL_SIZE : at + _CENTRAL_SIZE + name_n]
            extra = data[at + _CENTRAL_SIZE + name_n : at + _CENTRAL_SIZE + name_n + extra_n]
            if _FULL32 in (full, stored, header):
                full, stored, header = _wide(extra, full, stored, header)
            if flags & 1:
                raise ArchiveError("members must not be encrypted")
            yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, full, stored, header)
            at += _CENTRAL_SIZE + name_n + extra_n + note_n

    def begin(self, name: str) -> int:
        """Where the bytes of a stored member start; its local header may differ from the central one."""
        if name not in self._begin:
            if name not in self.members:
                raise ArchiveError(f"no member {name}")
            member = self.members[name]
            if member.method != zipfile.ZIP_STORED:
                raise ArchiveError(f"{name} is compressed; only stored members have ranges")
            head = self._exactly(member.header, _LOCAL_SIZE)
            if head[:4] != _LOCAL:
                raise ArchiveError(f"no local header of {name}")
            self._begin[name] = member.header + _LOCAL_SIZE + sum(struct.unpack_from("<26xHH", head))
        return self._begin[name]

    def range(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        """Bytes of a stored member."""
        begin, size = self.begin(name), self.members[name].size
        length = size - start if length is None else length
        if start < 0 or length < 0 or start + length > size:
            raise ArchiveError(f"{length} bytes at {start} reach beyond {name}")
        return self._exactly(begin + start, length)


def _wide(extra: bytes, full: int, stored: int, header: int) -> tuple[int, int, int]:
    """Sizes and place from the ZIP64 extra field, which holds only those that are full elsewhere."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            numbers = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            try:
                return tuple(next(numbers) if x == _FULL32 else x for x in (full, stored, header))
            except StopIteration:
                break
        at += 4 + length
    raise ArchiveError("a ZIP64 extra field is missing")


# -- records ------------------------------------------------------------------------------------


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    """A value that cannot end its header line; line ends and controls are per cent encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, head: int | None) -> bytes:
    """One WARC record: a response, or without payload a revisit of page ``head``."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if head is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if head is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}"]
    lines.append(f"WARC-Date: {DATE}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if head is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {name(head)}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _headers(data: bytes, at: int, first: bytes) -> tuple[dict[str, str], int]:
    """Headers from ``at`` up to the empty line, and where what follows begins."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or not data.startswith(first, at):
        raise ArchiveError(f"no {first.decode()} header")
    pairs = [line.partition(":") for line in data[at:end].decode().split("\r\n")[1:]]
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, end + 4


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def parsed(data: bytes) -> tuple[int | None, str | None, str, int | None, int, str, bytes | None]:
    """What ``record`` wrote: page id, url, type, page referred to, payload bytes, digest, payload."""
    warc, at = _headers(data, 0, b"WARC/1.")
    end = at + int(warc["content-length"])
    if data[end:] != b"\r\n\r\n":
        raise ArchiveError("a record does not end where it says")
    http, at = _headers(data, at, b"HTTP/")
    size, said = int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:")
    payload = data[at:end] if warc["warc-type"] == "response" else None
    if payload is not None and (len(payload) != size or digest(payload) != said):
        raise ArchiveError(f"the payload of {warc['warc-record-id']} is not the one that was written")
    return (
        _page(warc["warc-record-id"]), warc.get("warc-target-uri"), warc["warc-type"],
        _page(warc.get("warc-refers-to")), size, said, payload,
    )


def records(package: Package) -> Iterator[tuple]:
    """All records of a package by the ranges of its index."""
    for line in package.range(INDEX).splitlines():
        place = json.loads(line)
        data = package.range(DATA, place["offset"], place["length"])
        try:
            yield parsed(zlib.decompress(data, wbits=31))
        except zlib.error as error:
            raise ArchiveError(f"no gzip member at {place['offset']}: {error}") from error


class PackageWriter:
    """Records of one package."""

    def __init__(self) -> None:
        self.data, self.index = io.BytesIO(), []

    def add(self, page_id: int | None, url: str | None, payload: bytes, head: int | None) -> None:
        press = zlib.compressobj(_LEVEL, wbits=31)
        member = press.compress(record(page_id, url, payload, head)) + press.flush()
        self.index.append({"page_id": page_id, "offset": self.data.tell(), "length": len(member)})
        self.data.write(member)

    def image(self) -> bytes:
        """The ZIP file. Members beyond 4 GB or 65,535 in number get ZIP64 fields."""
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
            for name, data in (
                (DATA, self.data.getvalue()),
                (INDEX, "".join(json.dumps(x) + "\n" for x in self.index).encode()),
            ):
                package.writestr(zipfile.ZipInfo(name), data)  # a fixed date
        return out.getvalue()


# -- Spark --------------------------------------------------------------------------------------


def packages(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All pages as records in ZIP packages (package, image), a row per package.

    Of pages with equal payloads of ``min_bytes`` bytes or more, the one with the largest id is a response
    and the others revisit it; rows that repeat this id are responses all. Null html is an empty payload.
    Null ids never lead while another has the same payload; ids are whole numbers. Other columns are
    ignored. Equality is told by SHA-256 and size, counted before any page moves; pages move at most once.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    page = F.col(id_col).cast("long").alias("page_id")
    content = F.sha2(payload, 256).alias("content")
    counted = pages.filter(F.octet_length(payload) >= min_bytes).select(page, content)
    heads = counted.groupBy("content").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
    # written, so that the join can split a payload that many pages share
    heads = cut_lineage(heads.filter("n > 1").select("content", "head"), "warc-heads")
    rows = pages.select(page, F.col(url_col).alias("url"), payload.alias("payload"), content)
    led = rows.join(heads, "content", "left").select(
        "page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("head")
    )

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, writer = TaskContext.get().partitionId(), 0, PackageWriter()

        def closed() -> pa.RecordBatch:
            name = f"{shard:06d}-{number:06d}.wacz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([writer.image()], pa.binary())], ["package", "image"])

        for part in parts:
            for row in zip(*[part.column(i).to_pylist() for i in range(4)]):
                writer.add(*row)
                if writer.data.tell() >= PACKAGE_BYTES:
                    yield closed()
                    number, writer = number + 1, PackageWriter()
        if writer.index:
            yield closed()

    return led.mapInArrow(write, PACKAGES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = [c.split()[0] for c in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def _batches(name: str, package: Package, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in records(package):
        held.append((name, *row))
        size += len(row[-1] or b"") + 200
        if size > limit:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def read_packages(images: DataFrame) -> DataFrame:
    """All records of packages given as rows (package, image); revisits have a null payload.

    Columns: package, page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload. Size
    and digest are those of the full payload, which is held against them. A broken package raises.
    """

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, image in zip(part.column(0), part.column(1)):
                yield from _batches(name.as_py(), Package.of_bytes(image.as_buffer()))

    return images.select("package", "image").mapInArrow(read, RECORDS)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same for package files in a folder that all executors have mounted, a task per file."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path in part.column(0).to_pylist():
                with open(path, "rb") as file:
                    yield from _batches(os.path.basename(path), Package.of_file(file))

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(max(len(paths), 1)).mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write packages to the shared folder, read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to. The images are cells of a Parquet table, whose write is whole or absent."""
    path = fresh_path(pages.sparkSession, "warc-packages")
    packages(pages).write.option("compression", "uncompressed").parquet(path)
    images = pages.sparkSession.read.schema(PACKAGES).parquet(path)
    return read_packages(images).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same without archives, for the other engine; base32 takes five bits at a time from ten hex digits.
SQL = """
SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(10 * (i // 8) + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31)
      AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h,
  max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages)"""
