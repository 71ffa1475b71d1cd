"""ZIP-packaged WARC archives: round trips, the ZIP reader against the standard library's writer, damaged files."""

import base64
import gzip
import hashlib
import io
import json
import random
import zipfile

import pytest

from logweave.llm import warc_zip as wz
from logweave.llm.common import Scratch

COLUMNS = "page_id bigint, url string, html string, path string, offset bigint, revisit string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], COLUMNS).repartition(3)


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def expected(rows, min_bytes=0):
    least = {}
    for p, _, h in rows:
        least[h or ""] = min([x for x in (least.get(h or "", p), p) if x is not None], default=None)
    out = []
    for p, _, h in rows:
        h = h or ""
        first = p == least[h] or len(h.encode()) < min_bytes
        out.append((p, len(h.encode()), digest(h), "response" if first else "revisit", None if first else least[h]))
    return sorted(out, key=repr)


def read(spark, rows, **settings):
    scratch = Scratch(spark, "test")
    archives = wz.write_archives(pages(spark, rows), scratch, scratch.path("packed"), **settings)
    got = wz.read_records(wz.locate(archives))
    return archives.collect(), got.select("*", wz.page_of(got.record_id).alias("page_id"), wz.page_of(got.refers_to).alias("first")).collect()


@pytest.mark.parametrize("settings", [{}, {"min_bytes": 5, "archive_bytes": 4000}])
def test_pages_come_back(spark, settings):
    rng = random.Random(3)
    rows = [(i, f"http://a.example/{i}?q=é", rng.choice(["", None, "same", "longer same é😀", f"own {i}", "\r\n\r\nWARC/1.1\r\n"])) for i in range(300)]
    rows += [(400, None, "x" * 2_000_000), (401, "http://a b\n\tc\x7f", "x" * 2_000_000), (None, "u", "same"), (None, "v", "only null ids"), (5, "again", "own 5"), (7, "twice", "t"), (7, "twice", "t")]
    rows[5] = (5, "five", "own 5")
    archives, got = read(spark, rows, **settings)
    min_bytes = settings.get("min_bytes", 0)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.first) for r in got), key=repr) == expected(rows, min_bytes)
    assert all(r.intact for r in got) and sum(a.records for a in archives) == len(rows)
    assert ("archive_bytes" in settings) == (len(archives) > 3)
    bodies = {(p, digest(h or "")): (h or "").encode() for p, _, h in rows}
    assert all(r.payload is None if r.record_type == "revisit" else bytes(r.payload) == bodies[r.page_id, r.payload_digest] for r in got)
    targets = {r.page_id: r.target_uri for r in got}
    assert targets[400] is None and targets[401] == "http://a%20b%0A%09c%7F" and targets[3] == "http://a.example/3?q=é"
    with zipfile.ZipFile(archives[0].path.removeprefix("file:")) as packed:  # the standard library reads them too
        assert packed.testzip() is None and packed.namelist() == ["archive/data.warc.gz", "indexes/index.cdx", "datapackage.json"]
        assert len(gzip.decompress(packed.read("archive/data.warc.gz")).split(b"WARC-Record-ID")) >= archives[0].records


def test_no_pages(spark):
    archives, got = read(spark, [])
    assert archives == [] and got == []


def packed(parts, index="plain", before=b"", note=b"", method=zipfile.ZIP_STORED, name="data.warc.gz"):
    """An archive of gzip members as bytes; ``index``: plain, gz or none."""
    out = io.BytesIO()
    out.write(before)
    with zipfile.ZipFile(out, "a", method) as z:
        z.comment = note
        z.writestr("a/first.bin", b"skip me", zipfile.ZIP_DEFLATED)
        z.writestr(f"archive/{name}", b"".join(parts))
        at, lines = 0, []
        for p in parts:
            lines.append(f"k 2020 {json.dumps({'filename': name, 'offset': at, 'length': len(p)})}\n".encode())
            at += len(p)
        if index == "plain":
            z.writestr("indexes/index.cdx", b"!meta line\n" + b"".join(lines))
        elif index == "gz":
            z.writestr("indexes/index.cdx.gz", b"".join(gzip.compress(x) for x in lines))
    return out.getvalue()


RECORDS = [wz.encode_record(i, f"http://x/{i}", f"body {i}".encode() * (1 if i % 5 else 30_000)) for i in range(40)]


def places(tmp_path, data):
    path = tmp_path / "a.wacz"
    path.write_bytes(data)
    file = wz.RangeFile(str(path))
    return [file.read(at, n) for _, at, n in wz._records_of(str(path))], list(wz.members(file))


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("index", ["plain", "gz", "none"])
@pytest.mark.parametrize("before, note", [(b"", b""), (b"#!self extracting\n" * 9, b"a PK\x05\x06 in a note" + b"n" * 30)])
def test_directories_of_other_writers(tmp_path, monkeypatch, zip64, index, before, note):
    if zip64:  # every limit is passed, so all sizes, offsets and counts stand in the ZIP64 records
        for limit in ("ZIP64_LIMIT", "ZIP_FILECOUNT_LIMIT"):
            monkeypatch.setattr(zipfile, limit, 1)
    parts = [gzip.compress(r) for r in RECORDS]
    got, found = places(tmp_path, packed(parts, index, before, note))
    assert sorted(got) == sorted(parts)
    assert [m[0] for m in found][:2] == ["a/first.bin", "archive/data.warc.gz"] and found[1][3] == sum(map(len, parts))


def test_plain_members_are_walked(tmp_path):
    got, _ = places(tmp_path, packed(RECORDS, "none", name="data.warc"))
    assert got == RECORDS
    assert [wz.decode_record(r)["payload_bytes"] for r in got[:2]] == [len(b"body 0") * 30_000, 6]


def test_many_members(tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(70_000):  # past the 65,535 entries that the plain end record can count
            z.writestr(f"m{i}", b"")
        z.writestr("archive/data.warc", RECORDS[1])
    got, found = places(tmp_path, out.getvalue())
    assert got == [RECORDS[1]] and len(found) == 70_001


def test_damaged_archives_are_errors(tmp_path):
    parts = [gzip.compress(r) for r in RECORDS]
    whole = packed(parts)
    for bad, why in ((whole[:-30], "no end"), (b"", "no end"), (packed(parts, method=zipfile.ZIP_DEFLATED), "compressed"), (whole.replace(b"PK\x01\x02", b"PK\x00\x00"), "damaged")):
        with pytest.raises(ValueError, match=why):
            places(tmp_path, bad)
    for raw in (b"", b"HTTP/1.1 200 OK\r\n\r\n", RECORDS[1][:-20]):
        with pytest.raises(ValueError):
            wz.decode_record(raw)
    assert not wz.decode_record(RECORDS[1].replace(b"body 1", b"BODY 1"))["intact"]
