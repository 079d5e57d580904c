"""WARC records in ZIP-packaged archives: writer and range reader.

An archive is a ZIP file whose members are stored, not compressed: one WARC
file of gzip records, and an index with the place of every record. The reader
finds the central directory from the end of the file (with ZIP64 fields where
they are needed), locates the members and reads single records by byte range;
nothing is extracted.

Archives lie in a folder that all executors reach. Each attempt of a task writes
files of its own, and only those of the attempt that succeeded are listed.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm.common import written
from kpiloom.session import scratch_path

WARC_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdxj"

#: An archive is closed beyond so many bytes of records.
ARCHIVE_BYTES = 256 << 20

#: Records whose places a task passes on together.
PLACES = 4096

#: Signatures and sizes of ZIP structures, WARC revisit profile.
END, END64, LOCATOR64, CENTRAL, LOCAL = (b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04")
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int


class ArchiveError(ValueError):
    """The file is no archive of this kind, or is damaged."""


def _at(file: Any, offset: int, size: int) -> bytes:
    file.seek(offset)
    data = file.read(size)
    if len(data) != size:
        raise ArchiveError(f"{size} bytes wanted at {offset}, {len(data)} there")
    return data


def _directory(file: Any, size: int) -> tuple[int, int, int]:
    """Entries, bytes and offset of the central directory."""
    back = min(size, 22 + FULL16)
    tail = _at(file, size - back, back)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ArchiveError("no end of central directory")
    entries, length, offset = struct.unpack_from("<HLL", tail, at + 10)
    if FULL16 in (entries,) or FULL32 in (length, offset):
        place = size - back + at - 20
        locator = _at(file, place, 20) if place >= 0 else b""
        if locator[:4] != LOCATOR64:
            raise ArchiveError("no ZIP64 locator")
        record = _at(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != END64:
            raise ArchiveError("no ZIP64 end of central directory")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    return entries, length, offset


def members(file: Any, size: int) -> list[Member]:
    """All members by the central directory, ZIP64 fields included."""
    entries, length, offset = _directory(file, size)
    data, at, out = _at(file, offset, length), 0, []
    for _ in range(entries):
        if data[at : at + 4] != CENTRAL:
            raise ArchiveError("damaged central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, full = struct.unpack_from("<LL", data, at + 20)
        n_name, n_extra, n_comment, disk = struct.unpack_from("<HHHH", data, at + 28)
        header = struct.unpack_from("<L", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, place = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while place + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, place)
            if kind == 1:
                wide = place + 4
                if full == FULL32:
                    full, wide = struct.unpack_from("<Q", extra, wide)[0], wide + 8
                if packed == FULL32:
                    packed, wide = struct.unpack_from("<Q", extra, wide)[0], wide + 8
                if header == FULL32:
                    header = struct.unpack_from("<Q", extra, wide)[0]
            place += 4 + n
        out.append(Member(name, method, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return out


def stored_start(file: Any, member: Member) -> int:
    """Offset of a stored member's first byte."""
    if member.method != 0:
        raise ArchiveError(f"{member.name} is not stored")
    head = _at(file, member.header, 30)
    if head[:4] != LOCAL:
        raise ArchiveError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def record_places(file: Any, size: int) -> Iterator[tuple[int, int]]:
    """Offset in the archive and bytes of every record, by the index."""
    found = {m.name: m for m in members(file, size)}
    if WARC_MEMBER not in found or INDEX_MEMBER not in found:
        raise ArchiveError("no records or no index in the archive")
    start, index = stored_start(file, found[WARC_MEMBER]), found[INDEX_MEMBER]
    for line in _at(file, stored_start(file, index), index.size).splitlines():
        place = json.loads(line.split(b" ", 2)[2])
        yield start + int(place["offset"]), int(place["length"])


def record(page: str, url: str, payload: bytes | None, length: int, digest: str, refers_to: str | None) -> bytes:
    """One gzip member with a response record, or a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"" if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    body = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(body) + packer.flush()


class Parsed(NamedTuple):
    page: str
    kind: str
    length: int
    digest: str
    refers_to: str | None
    payload: bytes | None


def parse_record(data: bytes) -> Parsed:
    """The record of a gzip member; a response's payload must have the digest
    that the record names."""
    body = zlib.decompress(data, 31)
    head, _, rest = body.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    ident = lambda name: fields[name].removeprefix("<urn:page:").removesuffix(">") if name in fields else None
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ArchiveError(f"payload of {ident('WARC-Record-ID')} is not what its record says")
    return Parsed(ident("WARC-Record-ID"), kind, length, digest, ident("WARC-Refers-To"), payload if kind == "response" else None)


class ArchiveWriter:
    """Writes records and their index into one ZIP file, stored."""

    def __init__(self, sink: Any):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(WARC_MEMBER, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True)
        self.offset, self.index = 0, []

    def add(self, page: str, data: bytes) -> None:
        self.data.write(data)
        self.index.append(f"{page} 20240101000000 {json.dumps({'offset': self.offset, 'length': len(data)})}\n")
        self.offset += len(data)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER, (2024, 1, 1, 0, 0, 0)), "".join(self.index))
        self.zip.close()


def _line(text: str | None) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in text or "")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """One row per archive written: ``path``, ``records``, ``bytes``. ``records``
    has text ``page``, ``url``, ``refers_to`` and binary ``payload``, long
    ``length``, text ``digest``. The rows are those of the attempts that
    succeeded, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(root, recursive=True)
        task, rows, open_ = TaskContext.get(), [], None

        def close() -> None:
            nonlocal open_
            if open_ is not None:
                path, sink, writer = open_
                writer.close()
                sink.close()
                rows.append((path, len(writer.index), writer.offset))
                open_ = None

        for batch in batches:
            for page, url, refers_to, payload, length, digest in zip(*(batch.column(c) for c in ("page", "url", "refers_to", "payload", "length", "digest"))):
                if open_ is None:
                    path = f"{root}/part-{task.partitionId():05d}-{uuid.uuid4().hex}.zip"
                    sink = store.open_output_stream(path)
                    open_ = (path, sink, ArchiveWriter(sink))
                name = page.as_py()
                open_[2].add(name, record(name, _line(url.as_py()), payload.as_py(), length.as_py(), digest.as_py(), refers_to.as_py()))
                if open_[2].offset >= ARCHIVE_BYTES:
                    close()
        close()
        columns = list(zip(*rows)) if rows else [()] * 3
        types = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["path", "records", "bytes"])

    listed = records.mapInArrow(run, "path string, records long, bytes long")
    return written(listed, "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of the listed archives: ``page``, ``record_type``,
    ``payload_bytes``, ``payload_digest``, ``refers_to``, ``payload`` (null for
    revisits). The places of the records are dealt out before they are read."""
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(path) as file:
                    rows: list[tuple[str, int, int]] = []
                    for offset, length in record_places(file, file.size()):
                        rows.append((path, offset, length))
                        if len(rows) == PLACES:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    def _rows(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 3
        types = (pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["path", "offset", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(uri)
        types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
        names = ["page", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        file, at = None, None
        for batch in batches:
            out: list[Parsed] = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != at:
                    if file is not None:
                        file.close()
                    file, at = store.open_input_file(path), path
                out.append(parse_record(_at(file, offset, length)))
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)
        if file is not None:
            file.close()

    places = archives.select("path").mapInArrow(locate, "path string, offset long, length long")
    block = F.floor(F.col("offset") / (16 << 20))
    dealt = places.repartition("path", block).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(
        read, "page string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"
    )


def plan_records(pages: DataFrame, id: str, url: str, html: str, shortest: int) -> DataFrame:
    """What to write for each row: of equal payloads of at least ``shortest``
    bytes the largest id is the response that the others refer to."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("length", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    long_ = rows.where(F.col("length") >= shortest)
    repeated = long_.groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1").select("digest", "response")
    joined = rows.join(written(repeated, "repeated"), "digest", "left")
    revisit = F.col("response").isNotNull() & (F.col("length") >= shortest) & ~F.col("id").eqNullSafe(F.col("response"))
    return joined.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("page"),
        "url",
        F.when(revisit, F.col("response").cast("string")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
        "length",
        "digest",
    )


def archive_round_trip(
    pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", shortest: int = 1000, folder: str | None = None
) -> DataFrame:
    """Writes a WARC record for every row of ``pages`` into archives and returns
    what the archives hold: the id, ``payload_bytes``, ``payload_digest``,
    ``record_type`` and ``refers_to``.

    Null html is an empty payload. Repeated rows are written as often as they
    occur; of a group, all rows with the largest id are responses, and a null id
    revisits. Line breaks in an address are escaped. An empty table gives an
    empty result, and extra columns are not read.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    found = read_archives(write_archives(plan_records(pages, id, url, html, shortest), folder), folder)
    kind = pages.schema[id].dataType
    back = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return found.select(back("page").alias(id), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to"))
