"""WARC records in ZIP-packaged archives: writing, and reading by ranges without extraction.

An archive is a ZIP file whose members are stored, not compressed: ``archive/*.warc.gz`` (one gzip
member per record), ``indexes/*.cdx`` (a line per record: key, time, and JSON with member, offset and length).
The reader parses the end record and the central directory, both in their ZIP64 forms too,
finds where each stored member starts by its local header, takes the records' places from
the indexes (a member that no index names is walked from record to record), and reads each record by its
range.  Nothing is unpacked and no archive is read whole.

Spark: one row per archive is dealt out to locate its records; these rows (path, offset, length) are dealt out again by
runs of 8 MiB, so a single huge archive is read by many tasks; within a run reads are sequential with 1 MiB of read-ahead.
Writing: each task fills archives of up to ``archive_bytes`` and reports the ones it finished; a
failed attempt leaves files under names of its own that no table lists.  Files are opened with ``pyarrow.fs`` (local or
mounted folders, HDFS, S3, GCS), for Spark has no writer of ZIP files.

Equal payloads: the smallest page_id keeps the payload (``response``), the others are ``revisit`` records that name it.  They
are found by a pre-aggregated count on SHA-256; only payloads that repeat are joined back, from a stored table, so adaptive
execution broadcasts it if small and can split a hot payload if not.

Defined results: a null html is an empty payload; null ids come last; rows that share the smallest id of a payload
are all responses; a null url has no target; control characters of a url are percent-encoded; an archive with a damaged
directory or a compressed WARC member is an error that names the file; an empty table gives no archive; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import sys
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["mark_revisits", "write_archives", "locate", "read_records", "page_of", "members", "data_start", "RangeFile"]

RUN = 8 << 20  # bytes of an archive that one task reads in a row
AHEAD = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format


# -- records --------------------------------------------------------------------------------
def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_of(record: Column) -> Column:
    """The page_id in a record id that ``write_archives`` made, else null."""
    return F.regexp_extract(record, r"^<urn:page:(-?[0-9]+):", 1).try_cast("bigint")


def encode_record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record; a revisit has the HTTP head of its page but no payload."""
    digest = bare_digest(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines[1:] if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def decode_record(raw: bytes) -> dict:
    """A record's id, type, target, the record it refers to, payload (None in a revisit), its size and digest.

    ``intact`` tells whether the payload has the digest that its head states."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    warc = _fields(head)
    size = int(warc["content-length"])
    if len(rest) < size:
        raise ValueError("cut off WARC record")
    block, http = rest[:size], {}
    if warc.get("content-type", "").startswith("application/http"):
        top, _, block = block.partition(b"\r\n\r\n")
        http = _fields(top)
    stated = warc.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = warc.get("warc-type") == "revisit"
    digest = stated if revisit else bare_digest(block)
    return {
        "record_id": warc.get("warc-record-id"), "record_type": warc.get("warc-type"), "refers_to": warc.get("warc-refers-to"), "target_uri": warc.get("warc-target-uri"),
        "payload": None if revisit else block, "payload_bytes": int(http.get("content-length", 0)) if revisit else len(block),
        "payload_digest": digest, "intact": not stated or stated == digest,
    }


# -- files ----------------------------------------------------------------------------------
def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"(file:)?/", path):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path)


class RangeFile:
    """Ranges of a file; small reads that follow one another come from one read-ahead."""

    def __init__(self, path: str):
        system, name = _opened(path)
        self._file, self.path = system.open_input_file(name), path
        self.size, self._at, self._held = self._file.size(), 0, b""

    def read(self, offset: int, length: int) -> bytes:
        if not (self._at <= offset and offset + length <= self._at + len(self._held)):
            if offset < 0 or offset + length > self.size:
                raise ValueError(f"{self.path}: bytes {offset} to {offset + length} lie outside the file")
            self._at, self._held = offset, self._file.read_at(min(max(length, AHEAD), self.size - offset), offset)
        return self._held[offset - self._at : offset - self._at + length]

    def close(self) -> None:
        self._file.close()


# Fixed values of the ZIP format: signatures and layouts of its records.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_END, _END64, _LOCATOR64, _CENTRAL, _LOCAL = "<4s4H2LH", "<4sQ2H2L4Q", "<4sLQL", "<4s6H3L5H2L", "<4s5H3L2H"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def _end_of(file: RangeFile) -> tuple[int, int, int]:
    """(entries, start, size) of the central directory."""
    first = max(0, file.size - struct.calcsize(_END) - FULL16)
    tail = file.read(first, file.size - first)
    at = tail.rfind(END)
    while at >= 0 and (len(tail) - at < struct.calcsize(_END) or struct.unpack_from(_END, tail, at)[7] != len(tail) - at - struct.calcsize(_END)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError(f"{file.path}: no end of a ZIP directory")
    _, _, _, _, entries, size, start, _ = struct.unpack_from(_END, tail, at)
    at += first
    end = at
    if at >= struct.calcsize(_LOCATOR64) and (raw := file.read(at - struct.calcsize(_LOCATOR64), struct.calcsize(_LOCATOR64))).startswith(LOCATOR64):
        place = struct.unpack(_LOCATOR64, raw)[2]
        near = at - struct.calcsize(_LOCATOR64) - struct.calcsize(_END64)  # where it lies if bytes were put before the archive
        place = next((p for p in (place, near) if 0 <= p <= file.size - struct.calcsize(_END64) and file.read(p, 4) == END64), None)
        if place is None:
            raise ValueError(f"{file.path}: no ZIP64 end record")
        *_, entries, size, start = struct.unpack(_END64, file.read(place, struct.calcsize(_END64)))
        end = place
    return entries, end - size, end - size - start


def members(file: RangeFile) -> Iterator[tuple[str, int, int, int]]:
    """(name, method, offset of the local header, stored length) of every member, from the central directory."""
    entries, at, shift = _end_of(file)
    if at < 0:
        raise ValueError(f"{file.path}: damaged ZIP directory")
    for _ in range(entries):
        raw = file.read(at, struct.calcsize(_CENTRAL))
        sign, _, _, flags, method, _, _, _, stored, whole, n_name, n_extra, n_note, _, _, _, local = struct.unpack(_CENTRAL, raw)
        if sign != CENTRAL:
            raise ValueError(f"{file.path}: damaged ZIP directory")
        rest = file.read(at + struct.calcsize(_CENTRAL), n_name + n_extra)
        name = rest[:n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = rest[n_name:]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<2H", extra)
            if kind == 1:  # ZIP64: the full-size fields, in this order, for those that are saturated
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                whole = next(wide) if whole == FULL32 else whole
                stored = next(wide) if stored == FULL32 else stored
                local = next(wide) if local == FULL32 else local
                break
            extra = extra[4 + n :]
        yield name, method, local + shift, stored
        at += struct.calcsize(_CENTRAL) + n_name + n_extra + n_note


def data_start(file: RangeFile, local: int) -> int:
    """Where the data of the member with its local header at ``local`` begins; the header's own lengths count, not the directory's."""
    head = struct.unpack(_LOCAL, file.read(local, struct.calcsize(_LOCAL)))
    if head[0] != LOCAL:
        raise ValueError(f"{file.path}: no member at {local}")
    return local + struct.calcsize(_LOCAL) + head[9] + head[10]


# -- locating -------------------------------------------------------------------------------
def _pieces(file: RangeFile, start: int, length: int) -> Iterator[bytes]:
    for at in range(start, start + length, AHEAD):
        yield file.read(at, min(AHEAD, start + length - at))


def _index_lines(file: RangeFile, name: str, start: int, length: int) -> Iterator[bytes]:
    unpack, left = zlib.decompressobj(31) if name.endswith(".gz") else None, b""
    for piece in _pieces(file, start, length):
        text = b""
        while unpack and piece:  # several gzip members may follow one another
            text += unpack.decompress(piece)
            piece = unpack.unused_data
            unpack = zlib.decompressobj(31) if unpack.eof else unpack
        *lines, left = (left + (text if unpack else piece)).split(b"\n")
        yield from lines
    yield left


def _walk(file: RangeFile, name: str, start: int, length: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of a member without index."""
    at, end = start, start + length
    if name.endswith(".gz"):
        while at < end:
            unpack, read = zlib.decompressobj(31), at
            while not unpack.eof:
                if read >= end:
                    raise ValueError(f"{file.path}: cut off record at {at}")
                piece = file.read(read, min(AHEAD, end - read))
                unpack.decompress(piece)
                read += len(piece) - len(unpack.unused_data)
            yield at, read - at
            at = read
        return
    while at < end:
        head = b""
        while b"\r\n\r\n" not in head and at + len(head) < end:
            head += file.read(at + len(head), min(4096, end - at - len(head)))
        n = head.index(b"\r\n\r\n") + 4
        n += int(_fields(head[: n - 4])["content-length"]) + 4
        yield at, n
        at += n


def _records_of(path: str) -> Iterator[tuple[str, int, int]]:
    file = RangeFile(path)
    try:
        found = list(members(file))  # a name and three numbers per member
        data = {name.rpartition("/")[2]: (name, method, data_start(file, local), n) for name, method, local, n in found if re.search(r"\.warc(\.gz)?$", name)}
        for name, method, *_ in data.values():
            if method != 0:
                raise ValueError(f"{path}: {name} is compressed; only stored members can be read by ranges")
        named = set()
        for name, method, local, n in found:
            if re.match(r"indexes/.*\.cdxj?(\.gz)?$", name) and method == 0:
                for line in _index_lines(file, name, data_start(file, local), n):
                    if b"{" in line:
                        entry = json.loads(line[line.index(b"{") :])
                        where = str(entry["filename"]).rpartition("/")[2]
                        if where not in data:
                            raise ValueError(f"{path}: the index names {where}, which is not there")
                        named.add(where)
                        yield data[where][0], data[where][2] + int(entry["offset"]), int(entry["length"])
        for base, (name, _, start, n) in data.items():
            if base not in named:
                yield from ((name, at, size) for at, size in _walk(file, name, start, n))
    finally:
        file.close()


_PLACES = pa.schema([("path", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _locate_task(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            for place in _records_of(path):
                rows.append((path, *place))
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=_PLACES)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], schema=_PLACES)


def locate(archives: DataFrame) -> DataFrame:
    """``path, member, offset BIGINT, length BIGINT``: where each record of ``archives[path]`` lies in its file."""
    return archives.select("path").repartition("path").mapInArrow(_locate_task, "path string, member string, offset bigint, length bigint")


# -- reading --------------------------------------------------------------------------------
_RECORD = [("record_id", "string"), ("record_type", "string"), ("refers_to", "string"), ("target_uri", "string"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("intact", "boolean")]
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _read_task(fields: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]):
        file = None
        for batch in batches:
            rows, held = [], 0
            for path, member, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None or file.path != path:
                    if file:
                        file.close()
                    file = RangeFile(path)
                raw = file.read(offset, length)
                try:
                    got = decode_record(zlib.decompress(raw, 31) if member.endswith(".gz") else raw)
                except (ValueError, KeyError, zlib.error) as wrong:
                    raise ValueError(f"{path}, {member}, at {offset}: {wrong}") from wrong
                rows.append((path, offset, *(got[c] for c, _ in fields)))
                held += len(got["payload"] or b"")
                if held > RUN:
                    yield _batch(rows, fields)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, fields)
        if file:
            file.close()

    return run


def _batch(rows, fields):
    kinds = [pa.string(), pa.int64(), *(_ARROW[k] for _, k in fields)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "offset", *(c for c, _ in fields)])


def read_records(places: DataFrame, payload: bool = True) -> DataFrame:
    """The records at ``places`` (of ``locate``): ``path, offset`` and what ``decode_record`` finds, one row each.

    ``payload`` false leaves the payload itself out; its size and digest are still those of the whole payload."""
    fields = _RECORD + ([("payload", "binary")] if payload else [])
    dealt = places.repartition("path", F.expr(f"offset div {RUN}")).sortWithinPartitions("path", "offset").select("path", "member", "offset", "length")
    return dealt.mapInArrow(_read_task(fields), "path string, offset bigint, " + ", ".join(f"{c} {k}" for c, k in fields))


# -- writing --------------------------------------------------------------------------------
def mark_revisits(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, revisit BOOLEAN, first_id BIGINT`` for ``pages[page_id, url, html]``.

    Of equal payloads of at least ``min_bytes`` bytes the smallest page_id is kept; the others revisit it."""
    body = F.coalesce("html", F.lit(""))
    sized = pages.select("page_id", "url", body.alias("html"), F.when(F.octet_length(body) >= min_bytes, F.sha2(body.cast("binary"), 256)).alias("_sha"))
    place = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"))
    twins = sized.filter(F.col("_sha").isNotNull()).groupBy("_sha").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    twins = scratch.save(twins.select(F.col("_sha").alias("_twin"), F.col("_first.id").alias("first_id")), "twins")
    met = sized.join(twins, F.col("_sha") == F.col("_twin"), "left")
    revisit = F.col("_twin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return met.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first_id")).alias("first_id"))


def _pack(folder: str, name: str, parts: list[bytes], index: list[str]) -> tuple[str, int, int]:
    system, path = _opened(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as packed:
        when = (1980, 1, 1, 0, 0, 0)
        with packed.open(zipfile.ZipInfo("archive/data.warc.gz", when), "w", force_zip64=True) as member:
            for part in parts:
                member.write(part)
        packed.writestr(zipfile.ZipInfo("indexes/index.cdx", when), "\n".join(sorted(index)) + "\n")
        packed.writestr(zipfile.ZipInfo("datapackage.json", when), json.dumps({"profile": "data-package", "resources": [{"path": "archive/data.warc.gz"}, {"path": "indexes/index.cdx"}]}))
    return f"{folder}/{name}", sum(map(len, parts)), len(parts)


def _write_task(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]):
        attempt = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        parts, index, size, made = [], [], 0, 0

        def row(x):
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in x], names=["path", "bytes", "records"])

        for batch in batches:
            payloads = batch.column(2).cast(pa.binary())
            for page_id, url, body, revisit, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), payloads, *(batch.column(k).to_pylist() for k in (3, 4))):
                record = encode_record(page_id, url, body.as_py(), first, revisit)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                part = pack.compress(record) + pack.flush()
                entry = {"filename": "data.warc.gz", "offset": size, "length": len(part), "mime": "warc/revisit" if revisit else "text/html"}
                index.append(f"page:{page_id} 19700101000000 {json.dumps(entry)}")
                parts.append(part)
                size += len(part)
                if size >= archive_bytes:
                    yield row(_pack(folder, f"{attempt}-{made}.wacz", parts, index))
                    parts, index, size, made = [], [], 0, made + 1
        if parts:
            yield row(_pack(folder, f"{attempt}-{made}.wacz", parts, index))

    return run


def write_archives(pages: DataFrame, scratch: Scratch, folder: str, *, min_bytes: int = 0, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes ``pages[page_id, url, html]`` to archives in ``folder``, now; returns ``path, bytes, records`` of each.

    A task holds the packed records of the archive it fills, at most ``archive_bytes`` and one record more."""
    marked = mark_revisits(pages, scratch, min_bytes)
    return scratch.save(marked.mapInArrow(_write_task(folder, archive_bytes), "path string, bytes bigint, records bigint"), "archives")
