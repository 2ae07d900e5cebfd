"""Legacy web archives: write and parse ARC files, convert them to WARC, read WARC back.

An ARC file starts with a ``filedesc://`` record that names its version and fields; each record is a
header line whose last field is the declared length, then that many bytes and a line feed. Version 1
has five fields, version 2 ten. The converter walks the declared lengths and synthesises what WARC
needs and ARC lacks: record ids, ISO dates, record types and payload digests.

Archives are made and read whole by one task each and hold about ``ARCHIVE_BYTES`` of records (a
larger record stands alone), so a task's memory is bounded by them and the longest record. Files are
written and read by Spark's own text and binary sources, hence in any store that Spark reaches; they
are gzip files of UTF-8 text.

Defined cases: null html is empty; a null url is ``-``; white space and line ends in a url are
percent-encoded; rows with a null page_id, and repeated rows, are records of their own, and among
equal payloads with the same largest id the one that comes last in the archives is the response; an
empty table gives no rows; a declared length that the file can't meet is an error; other columns are
ignored.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, stored

ARCHIVE_BYTES = 8 << 20
#: Payloads below this are always stored in full.
REVISIT_BYTES = 1000
#: Fixed by the ARC format: the fields of each version's header lines.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Fixed by the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def arc_version(version: int, name: str, date: str) -> bytes:
    """The record that opens an ARC file."""
    body = f"{version} 0 tallyloom\n{' '.join(ARC_FIELDS[version])}\n".encode()
    known = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Archive-length": str(len(body))}
    return " ".join(known.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, date: str, content: bytes) -> bytes:
    known = {"URL": re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Archive-length": str(len(content))}
    return " ".join(known.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + content + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, content) of each record but the opening ones."""
    at, fields = 0, None
    while at < len(data):
        if data[at] == 10:  # blank lines may stand between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header without an end at byte {at}")
        values = data[at:end].decode().split(" ")
        if not values[-1].isdigit():
            raise ValueError(f"ARC header without a length at byte {at}")
        start, length = end + 1, int(values[-1])
        content = data[start : start + length]
        if len(content) < length or data[start + length : start + length + 1] not in (b"\n", b""):
            raise ValueError(f"ARC record at byte {at} doesn't have the {length} bytes that it declares")
        if values[0].startswith("filedesc://"):
            version = int(content.split(b" ", 1)[0])
            fields = content.split(b"\n")[1].decode().split(" ")
            if fields != ARC_FIELDS.get(version):
                raise ValueError(f"ARC version {version} with fields {fields}")
        elif fields is None or len(values) != len(fields):
            raise ValueError(f"ARC record at byte {at} has {len(values)} fields")
        else:
            yield at, dict(zip(fields, values, strict=True)), content
        at = start + length + 1


def http_message(page_id: int | None, payload: bytes) -> bytes:
    """The response that an archive holds for a page."""
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def http_parts(message: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head with its blank line, header fields in lower case, payload."""
    head, blank, payload = message.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return head + blank, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def warc_record(archive: str, offset: int, fields: dict[str, str], message: bytes, refers_to: tuple[int | None, str] | None) -> bytes:
    """A WARC record from a parsed ARC record; ``refers_to``: page id and record id of the response that it repeats."""
    head, _, payload = http_parts(message)
    date = fields["Archive-date"]
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {record_id(archive, offset)}",
        f"WARC-Date: {date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
        f"WARC-Target-URI: {fields['URL']}",
        f"WARC-IP-Address: {fields['IP-address']}",
        f"WARC-Payload-Digest: sha1:{sha1(payload).hexdigest()}",  # noqa: S324 - the format's digest
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers_to[1]}"]
        lines += [f"X-Refers-To-Page-Id: {refers_to[0]}"] if refers_to[0] is not None else []
    block = head if refers_to else message
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def record_id(archive: str, offset: int) -> str:
    """The same id for the same place each time, as a task may run again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record."""
    at = 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        _, fields, _ = http_parts(data[at:end])
        start, length = end + 4, int(fields["content-length"])
        if len(data) < start + length:
            raise ValueError(f"WARC record at byte {at} doesn't have the {length} bytes that it declares")
        yield fields, data[start : start + length]
        at = start + length


def _file(batch: pa.RecordBatch, i: int) -> tuple[str, bytes]:
    data = batch["content"][i].as_py()
    return batch["path"][i].as_py().rsplit("/", 1)[-1], gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _write_each(archives: DataFrame, path: str) -> None:
    """One gzip file for each row's text."""
    archives.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "gzip").text(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """ARC files under ``path`` of (page_id, url, html), versions 1 and 2 in turn, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, parts, size = 1, [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"value": [b"".join(parts).decode()]})

        for batch in batches:
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                if not parts:
                    parts.append(arc_version(version, "pages.arc", date))
                parts.append(arc_record(version, url.as_py() or "-", date, http_message(page_id.as_py(), (html.as_py() or "").encode())))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield done()
                    version, parts, size = 3 - version, [], 0
        if parts:
            yield done()

    _write_each(pages.select("page_id", "url", "html").mapInArrow(run, "value string"), path)


def arc_records(spark: SparkSession, path: str) -> DataFrame:
    """archive, offset, page_id, payload_bytes, digest of each record of the ARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = _file(batch, i)
                rows = []
                for offset, _, message in parse_arc(data):
                    _, http, payload = http_parts(message)
                    page = http.get("x-page-id")
                    rows.append((name, offset, None if page is None else int(page), len(payload), sha1(payload).hexdigest()))  # noqa: S324
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["archive", "offset", "page_id", "payload_bytes", "digest"])

    return _read(spark, path).mapInArrow(run, "archive string, offset long, page_id long, payload_bytes long, digest string")


def revisits(records: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """archive, offset, and to (the response's page_id, archive, offset) of each record that repeats another."""
    long = records.where(F.col("payload_bytes") >= least_bytes)
    place = F.struct("page_id", "archive", "offset")
    # a digest with very many records: summed before the shuffle here, and split by Spark in the join
    kept = long.groupBy("digest", "payload_bytes").agg(F.max(place).alias("to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = long.join(kept, ["digest", "payload_bytes"])
    return again.where((F.col("archive") != F.col("to.archive")) | (F.col("offset") != F.col("to.offset"))).select("archive", "offset", "to")


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = REVISIT_BYTES) -> None:
    """WARC files under ``warc_path``, one for each ARC file."""
    records = stored(arc_records(spark, arc_path), "arc-records")
    text = F.array(F.coalesce(F.col("to.page_id").cast("string"), F.lit("")), "to.archive", F.col("to.offset").cast("string"))
    # the records of one archive at most in each list
    lists = revisits(records, least_bytes).groupBy("archive").agg(F.collect_list(F.struct("offset", text.alias("to"))).alias("again"))
    lists = lists.select("archive", F.col("again.offset").alias("at"), F.col("again.to").alias("to"))
    files = _read(spark, arc_path).withColumn("archive", F.element_at(F.split("path", "/"), -1)).join(lists, "archive", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = _file(batch, i)
                to = dict(zip(batch["at"][i].as_py() or [], batch["to"][i].as_py() or [], strict=True))
                out = []
                for offset, fields, message in parse_arc(data):
                    target = to.get(offset)
                    refers = target and (int(target[0]) if target[0] else None, record_id(target[1], int(target[2])))
                    out.append(warc_record(name, offset, fields, message, refers))
                yield pa.RecordBatch.from_pydict({"value": [b"".join(out).decode()]})

    _write_each(files.select("path", "content", "at", "to").mapInArrow(run, "value string"), warc_path)


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and record_id of each record of the WARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for i in range(batch.num_rows):
                _, data = _file(batch, i)
                rows = []
                for fields, block in parse_warc(data):
                    _, http, payload = http_parts(block)
                    full = fields["warc-type"] == "response"
                    size = len(payload) if full else int(http["content-length"])
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if full and sha1(payload).hexdigest() != digest:  # noqa: S324
                        raise ValueError(f"payload of {fields['warc-record-id']} doesn't have its digest")
                    rows.append((number(http.get("x-page-id")), size, digest, fields["warc-type"], number(fields.get("x-refers-to-page-id")), fields["warc-record-id"]))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return _read(spark, path).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as ARC files, converted to WARC files, read back."""
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), arc)
    convert(spark, arc, warc)
    return warc_records(spark, warc).drop("record_id")


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS largest FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM k
"""
