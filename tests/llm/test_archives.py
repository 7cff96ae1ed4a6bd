"""ZIP-packaged web archives against Python's own reader and brute force."""

import base64
import hashlib
import io
import json
import zipfile
import zlib

import pytest

from cohortloom.llm import archives

SCHEMA = "page_id long, url string, html string, image string, head long"


def zipped(members, comment=b"", **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", **more) as z:
        z.comment = comment
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


@pytest.mark.parametrize("comment", [b"", b"note PK\x05\x06 within" + b"x" * 300, b"c" * 65_535])
def test_directory_and_ranges(comment):
    members = [("a.txt", b"alpha"), ("dir/é.bin", bytes(range(256)) * 50), ("empty", b"")]
    image = zipped(members, comment)
    for package in (archives.Package.of_bytes(image), archives.Package.of_file(io.BytesIO(image))):
        assert list(package.members) == [n for n, _ in members]
        for name, data in members:
            assert package.range(name) == data
            assert package.range(name, 2, 0) == b"" if len(data) > 2 else True
        assert package.range("dir/é.bin", 250, 20) == members[1][1][250:270]
        with pytest.raises(archives.ArchiveError):
            package.range("a.txt", 3, 3)
        with pytest.raises(archives.ArchiveError):
            package.range("absent")


def test_zip64_by_number_of_members():
    image = zipped([(f"m{i}", str(i)) for i in range(66_000)])
    package = archives.Package.of_bytes(image)
    assert len(package.members) == 66_000 and package.range("m65999") == b"65999"


def test_zip64_by_size(monkeypatch):
    # every size and place beyond this limit goes to the ZIP64 fields
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    data = bytes(range(200))
    image = zipped([("small", b"x"), ("large", data), ("last", b"yz")])
    assert b"PK\x06\x06" in image and b"PK\x06\x07" in image
    package = archives.Package.of_bytes(image)
    assert [package.range(n) for n in ("small", "large", "last")] == [b"x", data, b"yz"]


def test_large_sparse_file_is_read_by_ranges_only(tmp_path):
    # a member beyond 4 GB, most of it a hole in the file
    path, size = tmp_path / "large.zip", 5 << 30
    head = b"PK\x03\x04" + b"\x2d\0" + b"\0" * 20 + b"\x03\0" + b"\0\0" + b"big"
    extra = (1).to_bytes(2, "little") + (16).to_bytes(2, "little") + size.to_bytes(8, "little") * 2
    full = b"\xff" * 4
    central = b"PK\x01\x02" + b"\x2d\0\x2d\0" + b"\0" * 12 + full * 2 + b"\x03\0" + len(extra).to_bytes(2, "little")
    central += b"\0" * 10 + b"\0" * 4 + b"big" + extra
    start = len(head) + size
    end64 = b"PK\x06\x06" + (44).to_bytes(8, "little") + b"\x2d\0\x2d\0" + b"\0" * 8
    end64 += (1).to_bytes(8, "little") * 2 + len(central).to_bytes(8, "little") + start.to_bytes(8, "little")
    locator = b"PK\x06\x07" + b"\0" * 4 + (start + len(central)).to_bytes(8, "little") + b"\1\0\0\0"
    end = b"PK\x05\x06" + b"\0" * 4 + b"\xff" * 12 + b"\0\0"
    with open(path, "wb") as f:
        f.write(head)
        f.seek(len(head) + size - 4)
        f.write(b"tail" + central + end64 + locator + end)
    read = []
    with open(path, "rb") as f:
        package = archives.Package.of_file(f)
        exactly = package._read
        package._read = lambda a, n: read.append(n) or exactly(a, n)
        assert package.members["big"].size == size
        assert package.range("big", size - 4, 4) == b"tail" and package.range("big", 1 << 32, 3) == b"\0\0\0"
    assert sum(read) < 100
    with zipfile.ZipFile(path) as z:
        assert z.getinfo("big").file_size == size


def test_broken_packages_raise():
    image = zipped([("a", b"alpha")])
    for bad in (b"", b"PK", image[:-3], image[:-22], b"x" * 40 + image, image.replace(b"PK\x01\x02", b"PK\x01\x03")):
        with pytest.raises(archives.ArchiveError):
            archives.Package.of_bytes(bad).range("a")
    packed = zipped([("a", b"alpha" * 9)], compression=zipfile.ZIP_DEFLATED)
    with pytest.raises(archives.ArchiveError):
        archives.Package.of_bytes(packed).range("a")


def test_records_are_plain_warc():
    writer = archives.PackageWriter()
    writer.add(4, "http://x.org/a b\r\nEvil: 1", "é\r\n\r\nend".encode(), None)
    writer.add(None, None, b"", None)
    writer.add(-2, "u", "é\r\n\r\nend".encode(), 4)
    image = writer.image()
    with zipfile.ZipFile(io.BytesIO(image)) as z:
        assert z.testzip() is None and all(i.compress_type == 0 for i in z.infolist())
        data, lines = z.read(archives.DATA), z.read(archives.INDEX).splitlines()
    first = json.loads(lines[0])
    text = zlib.decompress(data[first["offset"] : first["offset"] + first["length"]], wbits=31)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"\r\nEvil" not in text
    got = list(archives.records(archives.Package.of_bytes(image)))
    sha = base64.b32encode(hashlib.sha1("é\r\n\r\nend".encode()).digest()).decode()
    assert got[0][2:] == ("response", None, 9, sha, "é\r\n\r\nend".encode())
    assert got[1][:5] == (None, None, "response", None, 0)
    assert got[2] == (-2, "u", "revisit", 4, 9, sha, None)
    at = data.find(b"\x1f\x8b") + 40
    broken = image.replace(data, data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :])
    with pytest.raises(archives.ArchiveError):
        list(archives.records(archives.Package.of_bytes(broken)))


DATA = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "u", "Ünique\x00\r\n"), (9, "u", "same"),
        (9, "u", "same"), (7, "u", "long " * 400_000), (8, "u", "long " * 400_000), (None, "u", "same"), (None, "u", "alone")]


def expected(data):
    largest = {}
    for page, _, html in data:
        if page is not None:
            largest[html or ""] = max(page, largest.get(html or "", page))
    out = []
    for page, _, html in data:
        payload, head = (html or "").encode(), largest.get(html or "")
        revisit = head is not None and head != page
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), sha, "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(rows, monkeypatch):
    monkeypatch.setattr(archives, "PACKAGE_BYTES", 2_000)
    got = archives.round_trip(rows([(i, u, h, "clash", 1) for i, u, h in DATA], SCHEMA)).collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted([tuple(r[c] for c in columns) for r in got], key=repr) == expected(DATA)


def test_small_payloads_never_lead(rows):
    made = archives.packages(rows([(i, u, h, "clash", 1) for i, u, h in DATA], SCHEMA), min_bytes=5)
    got = archives.read_packages(made).collect()
    assert {r["page_id"] for r in got if r["record_type"] == "revisit"} == {7}


def test_files_in_a_folder(rows, spark, tmp_path):
    table = rows([(i, u, h, "clash", 1) for i, u, h in DATA], SCHEMA)
    paths = []
    for r in archives.packages(table).collect():
        paths.append(str(tmp_path / r["package"]))
        with open(paths[-1], "wb") as f:
            f.write(r["image"])
    got = archives.read_files(spark, paths).collect()
    assert sorted((r["page_id"] is None, r["page_id"] or 0, r["payload"] or b"") for r in got)[0][1] == 1
    whole = {r["page_id"]: r["payload"] for r in got if r["record_type"] == "response" and r["page_id"] is not None}
    assert whole[8] == b"long " * 400_000 and whole[9] == b"same" and whole[5] == "Ünique\x00\r\n".encode()


def test_no_pages(rows):
    assert archives.round_trip(rows([], SCHEMA)).count() == 0
