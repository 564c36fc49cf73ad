"""Legacy ARC archives and their conversion to WARC.

An ARC file starts with a version block and then has, per record, a header line, as many bytes as that line declares,
and a newline. Version 1 lines have 5 fields, version 2 lines 10; the declared length is the last of either. The converter
makes record ids, ISO dates, record types and digests for WARC out of them, and turns all but one of the records with
an equal, not too short payload into revisits.

Both kinds of files are written by Spark's text writer with the record's own end as line separator, gzipped, in
archives of bounded size, and read as binary files, so any store that Spark reaches will do.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from harborline.llm.common import on_workers
from harborline.session import fresh_path, stored

# The field lists of the two ARC versions and the separators of both formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_END, WARC_END = "\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Uncompressed bytes after which a task begins the next archive, and records that a task hands on together.
ARCHIVE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
LEAST_REVISIT_BYTES = 1000
DATE = "20240101000000"
PAGE_HEADER = "X-Page-Id"


def write_archives(rows: DataFrame, path: str, end: str, head: Callable[[int], bytes], record: Callable[[tuple, int], bytes]) -> None:
    """Write one record per row, each archive beginning with ``head(its number in the task)``; no shuffle."""
    on_workers(rows.sparkSession)

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, place, held, out, size = -1, 0, ARCHIVE_BYTES, [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held >= ARCHIVE_BYTES:
                    archive, held = archive + 1, 0
                    out.append((archive, place, head(archive)))
                    place += 1
                data = record(row, archive)
                out.append((archive, place, data))
                place, held, size = place + 1, held + len(data), size + len(data)
                if size >= BATCH_BYTES:
                    yield as_batch(out)
                    out, size = [], 0
        if out:
            yield as_batch(out)

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))
        return pa.record_batch([pa.array(c, k) for c, k in columns], names=["archive", "place", "value"])

    placed = rows.mapInArrow(records, "archive int, place bigint, value binary").sortWithinPartitions("archive", "place")
    text = placed.select("archive", F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", end).option("compression", "gzip").option("maxRecordsPerFile", "0").partitionBy("archive").text(path)


def read_archives(spark: SparkSession, path: str, parse: Callable[[bytes, str], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """The records of all archives below ``path``; ``parse`` gets an archive's bytes and its name."""
    on_workers(spark)

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                out, size = [], 0
                for row in parse(unzipped(content.as_py()), name.as_py()):
                    out.append(row)
                    size += sum(len(v) for v in row if isinstance(v, bytes)) + 100
                    if size >= BATCH_BYTES:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(records, ddl)


def unzipped(data: bytes) -> bytes:
    """All members of a gzip file."""
    parts = []
    while data:
        member = zlib.decompressobj(31)
        parts += [member.decompress(data), member.flush()]
        data = member.unused_data
    return b"".join(parts)


def http_block(payload: bytes, page_id: int | None) -> bytes:
    page = "" if page_id is None else f"{PAGE_HEADER}: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{page}\r\n".encode() + payload


def one_field(text: str | None) -> str:
    """A text as one field of a header line: white space and control characters percent-encoded, ``-`` if there is none."""
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text or "") or "-"


def write_arc(pages: DataFrame, path: str, date: str = DATE) -> None:
    """An ARC record per row of ``pages`` (page_id, url, html); archives take version 1 and 2 in turn. Null html is empty."""

    def version(archive: int) -> int:
        return 1 + archive % 2

    def head(archive: int) -> bytes:
        fields = ARC_FIELDS[version(archive)]
        body = f"{version(archive)} 0 Harborline\n{fields}\n".encode()
        line = ["filedesc://archive.arc", "0.0.0.0", date, "text/plain", *["200", "-", "-", "0", "archive.arc"] * (version(archive) == 2), str(len(body))]
        return " ".join(line).encode() + b"\n" + body

    def record(row: tuple, archive: int) -> bytes:
        page_id, url, html = row
        block = http_block((html or "").encode("utf-8", "surrogatepass"), page_id)
        more = ["200", hashlib.md5(block).hexdigest(), "-", "0", "archive.arc"] if version(archive) == 2 else []
        line = [one_field(url), "0.0.0.0", date, "text/html", *more, str(len(block))]
        return " ".join(line).encode("utf-8", "replace") + b"\n" + block

    write_archives(pages.select("page_id", "url", "html"), path, ARC_END, head, record)


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of every record; the version block tells how header lines are read."""
    names, at = ARC_FIELDS[1].split(), 0
    while at < len(data):
        stop = data.find(b"\n", at)
        line = data[at:len(data) if stop < 0 else stop].decode("utf-8", "replace").rstrip("\r")
        if not line:  # empty lines between records
            at += 1
            continue
        values = line.split(" ")
        if line.startswith("filedesc:"):
            names = ARC_FIELDS[1 if len(values) == 5 else 2].split()
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"no ARC header line at {at}: {line[:200]}")
        fields, start = dict(zip(names, values)), stop + 1
        block = data[start:start + int(values[-1])]
        if len(block) != int(values[-1]):
            raise ValueError(f"the record at {at} is cut short")
        if line.startswith("filedesc:"):
            declared = block.split(b"\n")
            names = declared[1].decode("ascii").split()
        yield at, fields, block
        at = start + len(block)


def http_parts(block: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (lower-case names) and payload of an HTTP response; None if the block is none."""
    if not block.startswith(b"HTTP/"):
        return None
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in lines}, payload


def sha1(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()


def iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


CONVERTED = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("kind", pa.string()),
    ("mime", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary()),
])
CONVERTED_DDL = "record_id string, page_id bigint, url string, date string, kind string, mime string, payload_digest string, payload_bytes bigint, block binary"


def convert(spark: SparkSession, arc_path: str, with_block: bool = True) -> DataFrame:
    """Each ARC record with what WARC wants of it: id, ISO date, record type (response or resource), digests."""

    def parse(data: bytes, name: str) -> Iterator[tuple]:
        for at, fields, block in parse_arc(data):
            if fields["URL"].startswith("filedesc:"):
                continue
            parts = http_parts(block)
            headers, payload = parts or ({}, block)
            page = headers.get(PAGE_HEADER.lower())
            yield (
                str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{at}")), int(page) if page else None, fields["URL"], iso(fields["Archive-date"]),
                "response" if parts else "resource", "application/http;msgtype=response" if parts else fields["Content-type"],
                sha1(payload), len(payload), block if with_block else None,
            )

    return read_archives(spark, arc_path, parse, CONVERTED, CONVERTED_DDL)


def revisits(records: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(record_id, original_id, original_url, original_date) of the records that repeat the payload of another one.

    The original of a group is the response with the largest page_id, then record id. Groups shrink before the shuffle.
    """
    long = stored(records.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes)).select("record_id", "page_id", "payload_digest", "url", "date"), "payloads")
    original = long.groupBy(F.col("payload_digest").alias("of")).agg(
        F.max(F.struct("page_id", "record_id", "url", "date")).alias("original"), F.count("*").alias("n")
    ).where(F.col("n") > 1)
    found = long.join(original, F.col("payload_digest") == F.col("of")).where(F.col("record_id") != F.col("original.record_id"))
    return found.select(
        "record_id", F.col("original.record_id").alias("original_id"), F.col("original.url").alias("original_url"), F.col("original.date").alias("original_date")
    )


def write_warc(records: DataFrame, repeated: DataFrame, path: str) -> None:
    """A WARC record per row of ``convert``; those in ``repeated`` become revisits, which keep their HTTP header alone."""

    def head(archive: int) -> bytes:
        body = b"software: harborline\r\nformat: WARC File Format 1.1\r\n"
        return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(archive))}>"),
                            ("WARC-Date", iso(DATE)), ("Content-Type", "application/warc-fields")], body)

    def record(row: tuple, archive: int) -> bytes:
        record_id, url, date, kind, mime, digest, block, original, original_url, original_date = row
        headers = [("WARC-Type", "revisit" if original else kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", url)]
        if original:
            headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{original}>"),
                        ("WARC-Refers-To-Target-URI", original_url), ("WARC-Refers-To-Date", original_date)]
            block = block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
        headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", mime)]
        return warc_record(headers, block)

    rows = records.join(repeated, "record_id", "left").select(
        "record_id", "url", "date", "kind", "mime", "payload_digest", "block", "original_id", "original_url", "original_date"
    )
    write_archives(rows, path, WARC_END, head, record)


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record, by the declared lengths."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at {at}")
        lines = (line.partition(":") for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:])
        headers = {name.strip().lower(): value.strip() for name, _, value in lines}
        start = stop + 4
        at = start + int(headers["content-length"])
        if data[at:at + 4] != WARC_END.encode():
            raise ValueError(f"the record before {at} does not end there")
        yield headers, data[start:at]
        at += 4


READ = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to_record", pa.string()),
])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record but the warcinfo: of responses the payload is measured, of revisits the header tells. Digests are checked."""

    def parse(data: bytes, name: str) -> Iterator[tuple]:
        for headers, block in parse_warc(data):
            if headers["warc-type"] == "warcinfo":
                continue
            if headers["warc-block-digest"] != f"sha1:{sha1(block)}":
                raise ValueError(f"a block digest does not hold in {name}")
            http, payload = http_parts(block) or ({}, block)
            declared = headers["warc-payload-digest"].removeprefix("sha1:")
            whole = headers["warc-type"] != "revisit"
            if whole and sha1(payload) != declared:
                raise ValueError(f"a payload digest does not hold in {name}")
            page = http.get(PAGE_HEADER.lower())
            refers = headers.get("warc-refers-to")
            yield (
                headers["warc-record-id"][10:-1], headers["warc-type"], int(page) if page else None,
                len(payload) if whole else int(http["content-length"]), declared, refers[10:-1] if refers else None,
            )

    return read_archives(spark, path, parse, READ, "record_id string, record_type string, page_id bigint, payload_bytes bigint, payload_digest string, refers_to_record string")


def through_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """``pages`` written as ARC, converted to WARC and read back: one row per page.

    page_id, payload_bytes, payload_digest, record_type and refers_to (the page_id of a revisit's response). Null html is an empty
    payload, a null url or page_id stays unknown; an empty table gives no rows. Rows that repeat a page are records of their own.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "archives")
    write_arc(pages, f"{folder}/arc")
    write_warc(convert(spark, f"{folder}/arc"), revisits(convert(spark, f"{folder}/arc", with_block=False)), f"{folder}/warc")
    rows = stored(read_warc(spark, f"{folder}/warc"), "warc-index")
    responses = rows.select(F.col("record_id").alias("of"), F.col("page_id").alias("refers_to"))
    originals = responses.join(rows.select(F.col("refers_to_record").alias("of")).where(F.col("of").isNotNull()).distinct(), "of")
    return rows.join(originals, F.col("refers_to_record") == F.col("of"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
