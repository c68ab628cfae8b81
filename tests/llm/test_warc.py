"""WARC archives: round trips, revisits, and refusal of broken archives."""

import base64
import hashlib
import struct

import pytest
import zstandard

from quantloom.llm import warc


def archive(records):
    return b"".join(warc.write_archives(iter(records)))


def record(page, payload, refers=None):
    return warc.record_bytes(page, "http://a/b c", payload, hashlib.sha1(payload).hexdigest(), refers)


def test_records_round_trip():
    raw = [record(1, b""), record(2, "é\r\n\r\nx".encode()), record(3, b"y" * 3_000_000), record(4, b"y" * 3_000_000, 3), record(None, b"z")]
    got = list(warc.read_archive(archive(raw)))
    assert got == raw
    fields = [warc.parse_record(x) for x in got]
    assert [f["page_id"] for f in fields] == [1, 2, 3, 4, None]
    assert fields[3]["record_type"] == "revisit" and fields[3]["refers_to"] == 3 and fields[3]["payload_bytes"] == 3_000_000 and fields[3]["payload"] is None
    assert fields[2]["payload"] == b"y" * 3_000_000


def test_dictionary_leads_the_archive():
    content = archive([record(k, b"<html>%d</html>" % k * 40) for k in range(300)])
    magic, size = struct.unpack_from("<II", content)
    assert magic == warc.DICT_MAGIC and 0 < size < len(content)
    with pytest.raises(zstandard.ZstdError):  # a frame needs it
        zstandard.ZstdDecompressor().decompress(content[8 + size : warc.frame_end(memoryview(content), 8 + size)])


def test_separator_is_skipped():
    assert len(list(warc.read_archive(archive([record(1, b"a")]) + warc.SEPARATOR))) == 1
    assert list(warc.read_archive(b"")) == []


@pytest.mark.parametrize("cut", [1, 5, 40])
def test_cut_archives_are_refused(cut):
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(archive([record(1, b"abc" * 999)])[:-cut]))


def test_flipped_bytes_are_refused():
    content = bytearray(archive([record(1, b"abc" * 999)]))
    content[-8] ^= 0xFF
    with pytest.raises(warc.WarcError):
        [warc.parse_record(x) for x in warc.read_archive(bytes(content))]


@pytest.mark.parametrize(
    "old, new",
    [(b"Content-Length: 3\r", b"Content-Length: 4\r"), (b"WARC/1.1", b"WARX/1.1"), (b"WARC-Type: response", b"WARC-Type: nonsense"), (b"abc\r\n\r\n", b"abd\r\n\r\n"), (b"WARC-Date", b"WARC-Dote"), (b"abc\r\n\r\n", b"abc\r\n")],
)
def test_broken_records_are_refused(old, new):
    raw = record(1, b"abc")
    assert old in raw
    with pytest.raises(warc.WarcError):
        warc.parse_record(raw.replace(old, new, 1) if old != b"abc\r\n\r\n" else raw[::-1].replace(old[::-1], new[::-1], 1)[::-1])


def foreign(kind, block, more="", record_id="<urn:uuid:1f>"):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n{more}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_archives_of_others():
    """Other record types and ids, no content size, a compressed dictionary, base-32 digests."""
    body = b"<p>hello</p>"
    b32 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nodd line\r\nContent-Length: 12\r\n\r\n" + body
    records = [
        foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields\r\n"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http;msgtype=request\r\n"),
        foreign("response", http, f"Content-Type: application/http;msgtype=response\r\nWARC-Payload-Digest: sha1:{b32}\r\n"),
        foreign("response", b"dns", "Content-Type: text/dns\r\n"),
        foreign("metadata", b"a: b", "WARC-Block-Digest: md5:x\r\n"),
        foreign("revisit", b"", f"WARC-Profile: http://netpreserve.org/warc/1.0/revisit/server-not-modified\r\nWARC-Refers-To: <urn:uuid:1f>\r\nWARC-Payload-Digest: sha1:{b32}\r\n"),
    ]
    content = warc.train_dictionary(records * 20, 2000)
    packed = zstandard.ZstdCompressor().compress(content)
    frames = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False)
    made = []
    for r in records:
        one = frames.compressobj()
        made.append(one.compress(r) + one.flush())
    got = [warc.parse_record(x) for x in warc.read_archive(struct.pack("<II", warc.DICT_MAGIC, len(packed)) + packed + b"".join(made))]
    assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "response", "metadata", "revisit"]
    assert got[2]["payload"] == body and got[2]["payload_digest"] == got[5]["payload_digest"] == hashlib.sha1(body).hexdigest()
    assert got[3]["payload"] == b"dns" and got[5]["payload"] is None and {r["record_id"] for r in got} == {"urn:uuid:1f"} and {r["page_id"] for r in got} == {None}
    wrong = foreign("response", http, f"WARC-Payload-Digest: sha1:{base64.b32encode(b'0' * 20).decode()}\r\n")
    with pytest.raises(warc.WarcError):
        warc.parse_record(wrong)


def test_hot_payloads_are_joined_by_broadcast(spark):
    rows = [(k, "u", "x" * 1000 if k % 3 else f"{k}" * 1000) for k in range(300)] + [(None, "u", "x" * 1000), (300, "u", "7" * 1000), (301, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, warc.with_revisits(pages).select("page_id", "refers_to").collect()), key=repr)
    assert sorted(map(tuple, warc.with_revisits(pages, hot=50).select("page_id", "refers_to").collect()), key=repr) == want
    assert (1, 299) in want and (None, 299) in want and (299, None) in want and (301, None) in want


def read(spark, rows, tmp_path, extra=""):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string" + extra)
    path = f"file://{tmp_path}/warc"
    warc.write_warc(warc.with_revisits(pages), path)
    return {r.page_id: r for r in warc.read_warc(spark, path).collect()}


def test_revisits(spark, tmp_path):
    big, small = "x" * 1000, "x" * 999
    rows = [(k, f"u{k}", big) for k in (3, 9, 5)] + [(k, None, small) for k in (1, 2)] + [(7, "u", None), (8, "u", "é" * 600)]
    got = read(spark, rows, tmp_path)
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        3: ("revisit", 9), 5: ("revisit", 9), 9: ("response", None), 1: ("response", None), 2: ("response", None), 7: ("response", None), 8: ("response", None)
    }
    assert got[8].payload_bytes == 1200 and got[7].payload_bytes == 0 and got[3].payload_bytes == 1000
    assert got[8].payload_digest == hashlib.sha1(("é" * 600).encode()).hexdigest() and got[9].payload.decode() == big


def test_nulls_repeats_and_extra_columns(spark, tmp_path):
    rows = [(None, None, "y" * 2000, "d"), (4, "u", "y" * 2000, "d"), (4, "u", "y" * 2000, "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    made = warc.with_revisits(pages).collect()
    assert sorted((str(r.page_id), str(r.refers_to)) for r in made) == [("4", "None"), ("4", "None"), ("None", "4")]


def test_empty_table(spark, tmp_path):
    assert read(spark, [], tmp_path) == {}
