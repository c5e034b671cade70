"""WARC archives, and the converter of legacy ARC archives (operator 9).

ARC files open with a version block, which names the fields of the header line
of every record; a record is that line, and as many bytes as it declares.  The
converter synthesises the WARC identifier, date, type and digests.  Archives are
gzip files in the shared folder, written and read by Spark's own sinks and
sources, so any file system does.  A payload that a record with a larger page_id
also has is written as a revisit of that record, without the payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_path

#: Fields of the header line by version, as the version block names them.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
DATE = "20000101000000"
_GAP = re.compile(rb"[\x00-\x20\x7f]")
#: Plain bytes from which an archive is full, so that a task holds one of them, and no file grows with the input.
ARCHIVE_BYTES = 32_000_000
#: Parts that the records of one payload are split into where they meet its response.
SALTS = 8
RECORD = "page_id bigint, url string, ip string, date string, content_type string, block binary, payload_bytes bigint, payload_digest string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A record's identifier, from which the page's can be read again."""
    low = (page_id or 0) & (2**64 - 1)
    high = 0x5EED000000008000 | (0 if page_id is None else 1)
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low)}>"


def page_of(identifier: str | None) -> int | None:
    if not identifier:
        return None
    value = uuid.UUID(identifier[10:-1]).int
    low = value & (2**64 - 1)
    return (low - 2**64 if low >= 2**63 else low) if value >> 64 & 1 else None


def _http(page_id: int | None, payload: bytes) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_header(version: int) -> bytes:
    block = f"{version} 0 archive\n{FIELDS[version]}\n".encode()
    line = b"filedesc://pages.arc 0.0.0.0 %b text/plain" % DATE.encode()
    return line + (b" %d\n" if version == 1 else b" 200 - - 0 pages.arc %d\n") % len(block) + block


def arc_record(version: int, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    block = _http(page_id, payload)
    place = _GAP.sub(lambda m: b"%%%02X" % m[0][0], (url or "about:blank").encode()) or b"about:blank"
    line = b"%b 0.0.0.0 %b text/html" % (place, DATE.encode())
    return line + (b" %d\n" if version == 1 else b" 200 - - 0 pages.arc %d\n") % len(block) + block


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; raises ValueError on a line or length that doesn't fit."""
    at, fields = 0, None
    while at < len(data):
        if data[at] in b"\r\n":  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        parts = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r").split(" ")
        names = (fields or FIELDS[1 if len(parts) == 5 else 2]).split(" ")
        if end < 0 or len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}: {' '.join(parts)[:100]!r}")
        block = data[end + 1 : end + 1 + int(parts[-1])]
        if len(block) != int(parts[-1]):
            raise ValueError(f"the ARC record at byte {at} ends early")
        at = end + 1 + len(block)
        if parts[0].startswith("filedesc:"):
            lines = block.decode("utf-8", "replace").split("\n")
            fields = FIELDS.get(int(lines[0].split(" ")[0]), lines[1].strip())
        else:
            yield dict(zip(names, parts, strict=True)), block


def _head(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def warc_record(row: dict, refers_to: int | None, revisit: bool) -> bytes:
    when = row["date"]
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(row["page_id"])), ("WARC-Date", f"{when[:4]}-{when[4:6]}-{when[6:8]}T{when[8:10]}:{when[10:12]}:{when[12:14]}Z"), ("WARC-Target-URI", row["url"]), ("WARC-IP-Address", row["ip"]), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}")]
    block = row["block"]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
        block = block[: len(block) - row["payload_bytes"]]
    return _head([*fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")], block)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record, by declared length."""
    at = 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(end, at)].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = data[end + 4 : end + 4 + int(fields["content-length"])]
        if len(block) != int(fields["content-length"]):
            raise ValueError(f"the WARC record at byte {at} ends early")
        at = end + 4 + len(block)
        yield fields, block


def _payload_at(block: bytes) -> int:
    """Where an HTTP block's payload begins; 0 if the block is no HTTP response."""
    end = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -4
    return end + 4 if end >= -4 and (end >= 0 or not block.startswith(b"HTTP/")) else len(block)


def _http_field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def _gunzip(content: bytes) -> bytes:
    """All members of a gzip file; other content as it is."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content))
        content = member.unused_data
    return b"".join(parts)


def _archives(records: Iterator[bytes], head: bytes, between: bytes, most: int) -> Iterator[pa.RecordBatch]:
    """Records put together to archives of about `most` bytes, each with its own head; one archive a row."""
    parts, size = [head], 0
    for record in records:
        if size and size + len(record) > most:
            yield pa.record_batch([pa.array([between.join(parts)], pa.binary())], ["value"])
            parts, size = [head], 0
        parts.append(record)
        size += len(record)
    yield pa.record_batch([pa.array([between.join(parts)] if size else [], pa.binary())], ["value"])


def _write(archives: DataFrame, path: str, end: str) -> None:
    """Each row as a gzip file."""
    archives.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", end).option("compression", "gzip").text(path)


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Gzip ARC files of about archive_bytes, of version 1 or 2 by the partition in turn."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version = TaskContext.get().partitionId() % 2 + 1
        records = (arc_record(version, i, u, (h or "").encode()) for batch in batches for i, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from _archives(records, arc_header(version), b"\n", archive_bytes)

    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    _write(own.mapInArrow(rows, "value binary"), path, "\n")


def read_arcs(files: DataFrame) -> DataFrame:
    """Records (RECORD) of ARC files given as the rows of a binaryFile source; a file is read in one task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in RECORD.split(", ")]
        types = [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            for content in batch.column("content"):
                found = []
                for head, block in read_arc(_gunzip(content.as_py())):
                    at = _payload_at(block)
                    own = _http_field(block[:at], b"X-Page-Id")
                    found.append((int(own) if own is not None else None, head["URL"], head["IP-address"], head["Archive-date"], head["Content-type"], block, len(block) - at, base32_sha1(block[at:])))
                    if len(found) == 2000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)
                        found = []
                if found:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return files.select("content").mapInArrow(rows, RECORD)


def write_warc(records: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Gzip WARC files of about archive_bytes.

    Of records with equal payloads of least_bytes or more, that with the largest
    page_id is the response, the others (smaller or null ids) revisit it.
    """
    index = records.where(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_bytes", "payload_digest")
    top = index.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 and top is not null")
    top = top.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    again = index.withColumn("salt", F.expr(f"pmod(xxhash64(page_id), {SALTS})")).join(top, ["payload_digest", "payload_bytes", "salt"]).where("page_id is null or page_id < top").select(F.col("page_id").alias("of"), F.col("payload_digest").alias("digest"), "top").distinct()
    told = records.join(again, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("payload_digest") == F.col("digest")), "left").select(*records.columns, "top")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"software: strandline\r\nformat: WARC File Format 1.1\r\n"
        head = _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(info).digest()[:16], version=5)}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], info)
        records = (warc_record(r, r["top"], r["top"] is not None) for batch in batches for r in batch.to_pylist())
        yield from _archives(records, head, b"\r\n\r\n", archive_bytes)

    _write(told.mapInArrow(rows, "value binary"), path, "\r\n\r\n")


def read_warcs(files: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of the response and revisit records; digests are verified."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found = []
                for fields, block in read_warc(_gunzip(content.as_py())):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    at = _payload_at(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base32_sha1(block[at:]) != digest:
                        raise ValueError(f"the payload of {fields['warc-record-id']} doesn't have its digest")
                    size = int(_http_field(block[:at], b"Content-Length") or 0) if kind == "revisit" else len(block) - at
                    found.append((page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, kind, page_of(fields.get("warc-refers-to"))))
                if found:
                    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.select("content").mapInArrow(rows, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive_round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """pages as ARC archives, converted to WARC archives, and read back: one row for each row of pages.

    Null html is an empty payload, and counts as equal to other empty ones; a
    null url becomes about:blank; a null page_id comes back as null, and never is
    the response where a record with an id has the same payload; rows that share
    the largest id are all responses.  Other columns are ignored; an empty table
    gives no rows.
    """
    spark = pages.sparkSession
    base = shared_path(spark, "archives")
    write_arc(pages, f"{base}/arc", **columns)
    files = lambda kind: spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(f"{base}/{kind}")
    write_warc(read_arcs(files("arc")), f"{base}/warc")
    return read_warcs(files("warc"))
