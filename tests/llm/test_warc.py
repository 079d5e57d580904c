from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib

import pytest

from kpiloom.llm import warc
from kpiloom.llm.warc import (
    ArchiveError,
    ArchiveWriter,
    archive_round_trip,
    members,
    parse_record,
    plan_records,
    read_archives,
    record,
    record_places,
    stored_start,
    write_archives,
)

PAGES = "page_id long, url string, html string"


def archive(n=50):
    sink = io.BytesIO()
    writer = ArchiveWriter(sink)
    for i in range(n):
        body = f"payload {i}\r\n\r\n".encode() * i
        writer.add(str(i), record(str(i), "http://x", body, len(body), hashlib.sha1(body).hexdigest(), None))
    writer.close()
    return sink.getvalue()


def test_members_are_those_of_zipfile():
    data = archive()
    with zipfile.ZipFile(io.BytesIO(data)) as theirs:
        assert [(m.name, m.method, m.size, m.header) for m in members(io.BytesIO(data), len(data))] == [
            (i.filename, 0, i.compress_size, i.header_offset) for i in theirs.infolist()
        ]
        for m in members(io.BytesIO(data), len(data)):
            start = stored_start(io.BytesIO(data), m)
            assert data[start : start + m.size] == theirs.read(m.name)


def test_ranges_hold_the_records():
    data = archive()
    pages = [parse_record(data[a : a + n]) for a, n in record_places(io.BytesIO(data), len(data))]
    assert [p.page for p in pages] == [str(i) for i in range(50)]
    assert pages[3].payload == b"payload 3\r\n\r\n" * 3


def with_zip64(data):
    """The same archive with its directory in ZIP64 form."""
    at = data.rfind(b"PK\x05\x06")
    entries, length, offset = struct.unpack_from("<HLL", data, at + 10)
    central, made = data[offset : offset + length], b""
    while central:
        n, m, c = struct.unpack_from("<HHH", central, 28)
        packed, full = struct.unpack_from("<LL", central, 20)
        header = struct.unpack_from("<L", central, 42)[0]
        extra = struct.pack("<HHQQQ", 1, 24, full, packed, header) + struct.pack("<HH", 0x7777, 0)
        head = bytearray(central[: 46 + n])
        struct.pack_into("<LL", head, 20, 2**32 - 1, 2**32 - 1)
        struct.pack_into("<H", head, 30, len(extra))
        struct.pack_into("<L", head, 42, 2**32 - 1)
        made += bytes(head) + extra
        central = central[46 + n + m + c :]
    end = struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, entries, entries, len(made), offset)
    locator = struct.pack("<4sLQL", b"PK\x06\x07", 0, offset + len(made), 1)
    last = struct.pack("<4sHHHHLLH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 2**32 - 1, 2**32 - 1, 7)
    return data[:offset] + made + end + locator + last + b"comment"


def test_zip64_directories():
    data = archive()
    wide = with_zip64(data)
    assert members(io.BytesIO(wide), len(wide)) == members(io.BytesIO(data), len(data))
    assert list(record_places(io.BytesIO(wide), len(wide))) == list(record_places(io.BytesIO(data), len(data)))


def test_comments_with_signatures():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr("a", b"x")
        z.comment = b"PK\x05\x06 in a comment" + b"y" * 40
    data = sink.getvalue()
    assert [m.name for m in members(io.BytesIO(data), len(data))] == ["a"]


def test_damage_is_an_error():
    data = archive(3)
    for broken in (b"", b"no archive", data[:-30], data[: len(data) // 2]):
        with pytest.raises(ArchiveError):
            list(record_places(io.BytesIO(broken), len(broken)))
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.WARC_MEMBER, b"x" * 100)
        z.writestr(warc.INDEX_MEMBER, b"")
    with pytest.raises(ArchiveError):
        list(record_places(sink, len(sink.getvalue())))
    with pytest.raises(ArchiveError):
        parse_record(record("1", "u", b"abc", 3, "0" * 40, None))
    with pytest.raises(zlib.error):
        parse_record(b"abc")


def by_hand(rows, shortest=1000):
    largest = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= shortest and page is not None:
            largest[body] = max(page, largest.get(body, page))
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        to = largest.get(body)
        to = None if page == to else to
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("archive_bytes", [1 << 28, 3000])
def test_round_trip(docs, monkeypatch, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    big, other = "é" * 500, "x" * 1000
    rows = [(i, f"http://x/{i}", [big, other, "short", "y" * i][i % 4]) for i in range(80)]
    rows += [(None, None, big), (90, "http://x/\r\nX: y", None), (91, "é", ""), (92, "u", "z" * 3_000_000), (79, "again", "y" * 79)]
    got = sorted([tuple(r) for r in archive_round_trip(docs(rows, PAGES)).collect()], key=repr)
    assert got == by_hand(rows)


def test_payloads_come_back(docs, tmp_path):
    rows = [(i, "u", f"<html>\r\n\r\n{i} ñ" * 200) for i in range(20)]
    folder = f"file://{tmp_path}/archives"
    records = plan_records(docs(rows, PAGES), "page_id", "url", "html", 1000)
    listed = write_archives(records, folder)
    assert listed.count() == len(list((tmp_path / "archives").iterdir()))
    got = {int(r["page"]): r["payload"].decode() for r in read_archives(listed, folder).collect()}
    assert got == {i: html for i, _, html in rows}


def test_empty_table(docs):
    assert archive_round_trip(docs([], PAGES)).collect() == []
