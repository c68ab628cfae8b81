"""Zstandard WARC archives: write one frame per record after a dictionary frame, read them back.

An archive is a skippable frame (magic 0x184D2A5D) that holds the zstd dictionary, then one frame
for each record. Archives are written by Spark's own text sink, one row a file, so any file system
Spark knows will do and the output committer makes retries safe. The sink ends each row with a
separator; ours is an empty skippable frame, which zstd readers pass over.

The reader also takes archives of others: a dictionary that is itself compressed, frames without a content
size, records of any type and id, digests in base 32. An archive is one value, so it is bounded by Spark's 2 GB
for a value; a record is bounded by memory alone.

Defined results: a null html is an empty payload; a null page_id is kept (no WARC-Record-ID
number; it never wins over another id); repeated page_ids give a record each, so equal payloads under a
repeated largest page_id are a response each; an empty table gives no archive and an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import HOT_ROWS, arrow_rows, join_groups, materialise, scratch, table

DICT_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
#: The text sink's row separator: an empty skippable frame, all ASCII.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Record types of the format; those in HTTP have a payload after an HTTP head.
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
#: Compressed bytes of an archive: some 300,000 files for 20 TB.
ARCHIVE_BYTES = 64 << 20


class WarcError(ValueError):
    """An archive that breaks the format."""


# --- one record ---------------------------------------------------------------------------------


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit with the HTTP head alone."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
    ]
    if revisit:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(raw: bytes, first: bytes, strict: bool = True) -> dict[str, str]:
    lines = raw.split(b"\r\n")
    if not lines[0].startswith(first):
        raise WarcError(f"expected {first!r}, found {lines[0][:40]!r}")
    found, name = {}, None
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and name:  # goes on
            found[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if not colon or not key.strip():
            if strict:
                raise WarcError(f"malformed header line {line[:60]!r}")
            continue
        name = key.strip().lower().decode("latin-1")
        found[name] = value.strip().decode("utf-8", "replace")
    return found


def _number(value: str | None, what: str) -> int:
    if value is None or not value.isascii() or not value.isdigit():
        raise WarcError(f"{what} is not a length: {value!r}")
    return int(value)


def _page(value: str | None) -> int | None:
    """The number of a record id of ours; null for any other id."""
    number = value[10:-1] if value and value.startswith("<urn:page:") and value.endswith(">") else ""
    return int(number) if number.removeprefix("-").isdigit() else None


def _sha1(value: str | None) -> str | None:
    """A digest field as lower-case hex, from hex or base 32; null if it is absent or of another kind."""
    kind, _, digest = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return digest.lower() if len(digest) == 40 else base64.b32decode(digest.upper()).hex()
    except (binascii.Error, ValueError) as bad:
        raise WarcError(f"digest {value!r}") from bad


def parse_record(raw: bytes) -> dict:
    """Validate a whole record and return its fields; raises WarcError on any mismatch of a length or a SHA-1."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    if not blank:
        raise WarcError("the header does not end")
    fields = _fields(head, b"WARC/1.")
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if name not in fields:
            raise WarcError(f"{name} is missing")
    kind = fields["warc-type"]
    if kind not in TYPES:
        raise WarcError(f"record type {kind!r}")
    length = _number(fields.get("content-length"), "Content-Length")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length}, but the frame holds {len(rest) - 4} bytes")
    block = rest[:length]
    if (said := _sha1(fields.get("warc-block-digest"))) and said != hashlib.sha1(block).hexdigest():
        raise WarcError("the block does not have its digest")
    payload, size, digest = block, None, _sha1(fields.get("warc-payload-digest"))
    if kind in ("response", "request", "revisit") and "application/http" in fields.get("content-type", "application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not blank and kind != "revisit":
            raise WarcError("the HTTP head does not end")
        if http:
            of = _fields(http, b"" if kind == "request" else b"HTTP/", strict=False)
            size = None if "transfer-encoding" in of or "content-length" not in of else _number(of["content-length"], "HTTP Content-Length")
    if kind == "revisit":
        if payload or "warc-profile" not in fields:
            raise WarcError("a revisit with a payload or without a profile")
    elif "warc-truncated" not in fields:
        if size is not None and len(payload) != size:
            raise WarcError("the payload does not have its length")
        if digest and hashlib.sha1(payload).hexdigest() != digest:
            raise WarcError("the payload does not have its digest")
    revisit = kind == "revisit"
    return {
        "page_id": _page(fields["warc-record-id"]), "record_id": fields["warc-record-id"].strip("<>"), "url": fields.get("warc-target-uri"),
        "payload_bytes": size if revisit else len(payload), "payload_digest": digest or (None if revisit else hashlib.sha1(payload).hexdigest()),
        "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")) if revisit else None, "payload": None if revisit else payload,
    }


# --- frames -------------------------------------------------------------------------------------


def frame_end(data: memoryview, at: int) -> int:
    """Where the zstd frame that begins at `at` ends, from its header and block sizes alone."""
    try:
        params = zstandard.get_frame_parameters(bytes(data[at : at + 18]))
        pos = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    except zstandard.ZstdError as bad:
        raise WarcError(f"frame header at {at}: {bad}") from bad
    while True:
        if pos + 3 > len(data):
            raise WarcError(f"the frame at {at} is cut off")
        word = int.from_bytes(data[pos : pos + 3], "little")
        last, kind, size = word & 1, word >> 1 & 3, word >> 3
        if kind == 3:
            raise WarcError(f"reserved block type in the frame at {at}")
        pos += 3 + (1 if kind == 1 else size)
        if last:
            break
    pos += 4 * params.has_checksum
    if pos > len(data):
        raise WarcError(f"the frame at {at} is cut off")
    return pos


def _whole(frame: bytes, dictionary: zstandard.ZstdCompressionDict | None = None) -> bytes:
    """A frame's content, whether or not the frame says its size."""
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    try:
        one = reader.decompressobj()
        raw = one.decompress(frame)
    except zstandard.ZstdError as bad:
        raise WarcError(f"broken frame: {bad}") from bad
    size = zstandard.frame_content_size(frame)
    if not one.eof or (size >= 0 and size != len(raw)):
        raise WarcError("a frame does not have its content size")
    return raw


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time; only one record is decoded at once."""
    data, at, dictionary = memoryview(content), 0, None
    while at < len(data):
        if at + 8 > len(data):
            raise WarcError("the archive ends inside a frame head")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(data):
                raise WarcError("a skippable frame is cut off")
            if at == 0 and magic == DICT_MAGIC:
                held = bytes(data[8 : 8 + size])
                if held[:4] == struct.pack("<I", FRAME_MAGIC):
                    held = _whole(held)
                dictionary = zstandard.ZstdCompressionDict(held)
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        end = frame_end(data, at)
        yield _whole(bytes(data[at:end]), dictionary)
        at = end


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary from sample records; too few or too even samples give raw content instead."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"WARC/1.1\r\n"


def write_archives(records: Iterator[bytes], target_bytes: int = ARCHIVE_BYTES, dict_bytes: int = 16 << 10, level: int = 3) -> Iterator[bytes]:
    """Archives of about `target_bytes` each. A dictionary is trained on the first megabyte of the
    records of its archive; memory holds one archive and that megabyte."""
    records = iter(records)
    while True:
        first, seen = [], 0
        for raw in records:
            first.append(raw)
            seen += len(raw)
            if seen >= 1 << 20:
                break
        if not first:
            return
        content = train_dictionary([x[:32768] for x in first], dict_bytes)
        frames = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True, write_content_size=True)
        parts = [struct.pack("<II", DICT_MAGIC, len(content)), content, *map(frames.compress, first)]
        size = sum(map(len, parts))
        while size < target_bytes and (raw := next(records, None)) is not None:
            parts.append(frames.compress(raw))
            size += len(parts[-1])
        yield b"".join(parts)


# --- Spark --------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, min_bytes: int = 1000, hot: int = HOT_ROWS) -> DataFrame:
    """pages (page_id, url, html) with payload, digest and refers_to: of equal payloads of at
    least min_bytes the largest page_id is the response, the others refer to it.

    Groups are aggregated before the shuffle; pages of groups of over `hot` pages are joined by broadcast.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    made = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = made.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    groups = materialise(groups.where((F.col("n") > 1) & F.col("keeper").isNotNull()), "payload-groups")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return join_groups(made, groups, ["digest"], hot).select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_warc(pages: DataFrame, path: str, target_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of (page_id, url, payload, digest, refers_to) into archives at path."""

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (record_bytes(*row) for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True))
        for archive in write_archives(records, target_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], ["archive"])

    made = arrow_rows(pages.select("page_id", "url", "payload", "digest", "refers_to"), archives, "archive binary")
    made.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode("ascii")).option("maxRecordsPerFile", 1).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives at path, validated; a broken archive fails the query."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for raw in read_archive(content.as_buffer() if content.is_valid else b""):
                    rows.append(parse_record(raw))
                    held += len(raw)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return arrow_rows(files, records, "page_id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(with_revisits(table(spark, sf_dir, "pages")), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
k AS (SELECT body, max(page_id) AS keeper FROM p WHERE strlen(body) >= 1000 GROUP BY body)
SELECT p.page_id, CAST(strlen(p.body) AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
       CASE WHEN k.keeper IS NULL OR k.keeper = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to
FROM p LEFT JOIN k ON p.body = k.body
"""
