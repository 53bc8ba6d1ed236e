"""Legacy archives: parse ARC files of either version and convert them to WARC.

Files are written by Spark's text writer and read by its text reader, so they live in any store that Spark knows. They
are gzip files, which Spark never splits: a task sees the lines of a file in order and parses them as a stream by the
declared lengths. Memory is bounded by one record, however large a file is.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import salt_mask, salt_of, salts_in, shared_path

# Fixed values of the formats: the fields of a record's header line for each ARC version, and WARC's markers.
ARC_FIELDS = {
    1: ["url", "ip", "date", "content_type", "length"],
    2: ["url", "ip", "date", "content_type", "status", "checksum", "location", "offset", "filename", "length"],
}
ARC_ORIGIN = "corpusloom"
VERSION_RECORD = "filedesc://"
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_DATE = "20010101000000"
UNSAFE = re.compile(rb"[\x00-\x20\x7f%]")
BATCH_BYTES = 8 << 20

ARC_SCHEMA = "page_id long, url string, ip string, date string, content_type string, http binary, payload binary"
WARC_SCHEMA = (
    "page_id long, record_type string, record_id string, target_uri string, date string, payload binary, "
    "payload_bytes long, payload_digest string, refers_to long"
)


@dataclass
class Rows:
    """Collects rows and hands them on as Arrow batches of bounded size."""

    schema: pa.Schema

    def batches(self, rows: Iterable[tuple], size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0
        for row in rows:
            held.append(row)
            weight += size(row) + 64
            if weight >= BATCH_BYTES or len(held) >= 10_000:
                yield self._batch(held)
                held, weight = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, field.type) for column, field in zip(zip(*rows), self.schema, strict=True)], schema=self.schema
        )


def _schema(**types: pa.DataType) -> pa.Schema:
    return pa.schema(list(types.items()))


LINE = _schema(line=pa.binary())
ARC_ROWS = _schema(
    page_id=pa.int64(), url=pa.string(), ip=pa.string(), date=pa.string(), content_type=pa.string(), http=pa.binary(),
    payload=pa.binary(),
)
WARC_ROWS = _schema(
    page_id=pa.int64(), record_type=pa.string(), record_id=pa.string(), target_uri=pa.string(), date=pa.string(),
    payload=pa.binary(), payload_bytes=pa.int64(), payload_digest=pa.string(), refers_to=pa.int64(),
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _escape(value: bytes) -> bytes:
    """A header field without white space; '-' stands for none."""
    return UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], value) or b"-"


def _unescape(value: bytes) -> str | None:
    raw = b"" if value == b"-" else re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), value)
    return raw.decode("utf-8", "replace") or None


class Lines:
    """The lines of one file, with exact reads of declared lengths. Every line has lost its line feed."""

    def __init__(self, lines: Iterator[tuple[str, bytes]]):
        self.lines = lines
        self.ahead: tuple[str, bytes] | None = next(lines, None)

    @property
    def file(self) -> str | None:
        return self.ahead[0] if self.ahead else None

    def line(self) -> bytes:
        (_, value), self.ahead = self.ahead, next(self.lines, None)
        return value

    def read(self, length: int, file: str) -> tuple[bytes, bytes]:
        """`length` bytes, and what follows them on their last line."""
        parts, have = [], -1
        while have < length and self.file == file:
            parts.append(self.line())
            have += len(parts[-1]) + 1
        block = b"\n".join(parts)
        if len(block) < length:
            raise ValueError(f"{file} ends {length - len(block)} bytes before the declared length of its last record")
        return block[:length], block[length:]


def _lines(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line")
    )


def write_lines(rows: DataFrame, path: str, separator: str) -> str:
    """Write one record for each row and `separator` after it, compressed."""
    rows.select(F.col("line").cast("string").alias("value")).write.option("lineSep", separator).option("compression", "gzip").text(path)
    return path


# ---- ARC


def arc_version_record(version: int, name: str = "pages.arc") -> bytes:
    fields = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    body = f"{version} 0 {ARC_ORIGIN}\n{fields}\n".encode()
    rest = [b"0.0.0.0", ARC_DATE.encode(), b"text/plain"] + ([b"200", b"-", b"-", b"0", name.encode()] if version == 2 else [])
    return b" ".join([f"{VERSION_RECORD}{name}".encode(), *rest, b"%d" % len(body)]) + b"\n" + body


def arc_record(version: int, page_id: int | None, url: bytes, payload: bytes, date: str = ARC_DATE) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\nX-Page-Id: %s\r\n\r\n" % (
        len(payload), b"-" if page_id is None else b"%d" % page_id,
    )
    rest = [b"0.0.0.0", date.encode(), b"text/html"]
    if version == 2:
        rest += [b"200", payload_digest(payload).encode(), b"-", b"0", b"pages.arc"]
    return b" ".join([_escape(url), *rest, b"%d" % (len(http) + len(payload))]) + b"\n" + http + payload


def write_arc(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write pages as ARC files, a version block first in each; every other file uses version 2. Returns the folder.

    Null url: the field is '-'. Null html: empty. Null id: '-'. Other columns are ignored.
    """
    path = path or shared_path(pages.sparkSession, "arc")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).cast("binary").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"), (F.spark_partition_id() % 2 + 1).alias("version"),
    )

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bytes]]:
        started = False
        for batch in batches:
            for page_id, url, payload, version in zip(*(column.to_pylist() for column in batch.columns)):
                if not started:
                    yield (arc_version_record(version),)
                    started = True
                yield (arc_record(version, page_id, url, payload),)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Rows(LINE).batches(records(batches), lambda row: len(row[0]))

    return write_lines(rows.mapInArrow(write, "line binary"), path, "\n")


def parse_arc(lines: Lines) -> Iterator[tuple]:
    """The documents of ARC files. The version block of a file says how its header lines are read."""
    fields, seen = None, None
    while lines.file is not None:
        file = lines.file
        header = lines.line()
        if not header.strip():
            continue
        parts = header.rstrip(b"\r").split(b" ")
        if file != seen:
            fields, seen = None, file
        names = fields or (ARC_FIELDS[2] if len(parts) == len(ARC_FIELDS[2]) else ARC_FIELDS[1])
        if len(parts) > len(names):  # an old writer left spaces in its content type
            at = names.index("content_type")
            parts[at : at + len(parts) - len(names) + 1] = [b" ".join(parts[at : at + len(parts) - len(names) + 1])]
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"{file}: this is no header line of an ARC record: {header[:200]!r}")
        record = dict(zip(names, parts, strict=True))
        block, _ = lines.read(int(record["length"]), file)
        if parts[0].startswith(VERSION_RECORD.encode()):
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"{file}: ARC version {version} is unknown")
            fields = ARC_FIELDS[version]
            continue
        http, gap, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        number = re.search(rb"(?im)^x-page-id: (-?\d+)\r?$", http)
        yield (
            int(number[1]) if number else None, _unescape(record["url"]), record["ip"].decode("latin-1"), record["date"].decode("latin-1"),
            record["content_type"].decode("latin-1"), http + gap, payload,
        )


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The documents of all ARC files (gzip) below a folder."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Rows(ARC_ROWS).batches(parse_arc(Lines(_lines(batches))), lambda row: len(row[6]) + len(row[5]))

    return read_lines(spark, path).mapInArrow(parse, ARC_SCHEMA)


# ---- WARC


def warc_date(arc_date: str) -> str:
    """14 digits as a WARC date; shorter old dates are filled up, anything else becomes the epoch."""
    digits = re.sub(r"\D", "", arc_date)[:14]
    digits += "00000101000000"[len(digits) :] if len(digits) >= 4 else ""
    if len(digits) < 14:
        return "1970-01-01T00:00:00Z"
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"


def record_id(url: str | None, date: str, page_id: int | None, digest: str) -> str:
    """A name-based UUID: converting the same archive twice gives the same identifiers."""
    h = bytearray(hashlib.sha1(f"{url}\n{date}\n{page_id}\n{digest}".encode()).digest()[:16])
    h[6], h[8] = h[6] & 0x0F | 0x50, h[8] & 0x3F | 0x80
    x = h.hex()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def _number(page_id: int | None) -> str:
    return "-" if page_id is None else str(page_id)


def warc_record(row: dict, revisit_of: int | None, is_revisit: bool) -> bytes:
    payload, http = row["payload"], row["http"]
    digest, date = payload_digest(payload), warc_date(row["date"])
    block = http if is_revisit else http + payload
    heads = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_id(row["url"], date, row["page_id"], digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _escape((row["url"] or "").encode()).decode()),
        ("WARC-IP-Address", row["ip"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-Id", _number(row["page_id"])),
        ("X-Payload-Length", str(len(payload))),
    ]
    if is_revisit:
        heads += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", _number(revisit_of))]
    heads.append(("Content-Length", str(len(block))))
    return b"\r\n".join([WARC_VERSION, *(f"{k}: {v}".encode() for k, v in heads), b"", b""]) + block


def warcinfo() -> bytes:
    body = b"software: corpusloom\r\nformat: WARC File Format 1.1\r\nconversion: from ARC\r\n"
    heads = f"WARC-Type: warcinfo\r\nWARC-Record-ID: {record_id('warcinfo', '', None, '')}\r\nWARC-Date: {warc_date(ARC_DATE)}\r\n"
    return WARC_VERSION + b"\r\n" + heads.encode() + b"Content-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % len(body) + body


def parse_warc(lines: Lines) -> Iterator[tuple]:
    while lines.file is not None:
        file = lines.file
        first = lines.line().rstrip(b"\r")
        if not first:
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"{file}: a WARC record was expected, not {first[:200]!r}")
        heads: dict[str, str] = {}
        while lines.file == file and (line := lines.line().rstrip(b"\r")):
            name, _, value = line.decode("utf-8", "replace").partition(": ")
            heads[name.lower()] = value
        block, _ = lines.read(int(heads["content-length"]), file)
        kind = heads["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        digest = heads["warc-payload-digest"].removeprefix("sha1:")
        if heads["warc-block-digest"].removeprefix("sha1:") != payload_digest(block) or kind == "response" and digest != payload_digest(payload):
            raise ValueError(f"{file}: the digest of {heads['warc-record-id']} does not fit its content")
        number = lambda name: int(heads[name]) if heads.get(name, "-") != "-" else None
        yield (
            number("x-page-id"), kind, heads["warc-record-id"], _unescape(heads["warc-target-uri"].encode()), heads["warc-date"],
            payload if kind == "response" else None, number("x-payload-length"), digest, number("x-refers-to-page-id"),
        )


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The response and revisit records of all WARC files (gzip) below a folder, digests checked.

    Without `payloads` that column is null, and only sizes and digests leave the parser.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = parse_warc(Lines(_lines(batches)))
        if not payloads:
            rows = (row[:5] + (None,) + row[6:] for row in rows)
        yield from Rows(WARC_ROWS).batches(rows, lambda row: len(row[5] or b""))

    return read_lines(spark, path).mapInArrow(parse, WARC_SCHEMA)


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str | None = None, min_bytes: int = 0) -> str:
    """Convert all ARC files below a folder; returns the folder of the WARC files.

    Of documents with equal payloads of at least `min_bytes`, that with the smallest id becomes a response and the rest
    become revisits of it; smaller ones are all responses. Documents without an id come last: they are responses only
    where no document of their group has an id. Documents with the same id and payload are alike and share their type.
    """
    docs = read_arc(spark, arc_path).withColumns({"key": F.sha2("payload", 256), "salt": salt_of(F.col("page_id"), F.col("url"))})
    groups = (
        docs.where(F.octet_length("payload") >= min_bytes)
        .groupBy("key").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"), salt_mask("salt").alias("mask"))
        .where("n > 1")
        .select("key", "first_id", salts_in("mask").alias("salt"))
    )
    typed = docs.join(groups, ["key", "salt"], "left").select(
        "page_id", "url", "ip", "date", "http", "payload", "first_id",
        (F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("is_revisit"),
    )

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bytes]]:
        yield (warcinfo(),)
        for batch in batches:
            names = batch.schema.names
            for values in zip(*(column.to_pylist() for column in batch.columns)):
                row = dict(zip(names, values))
                yield (warc_record(row, row["first_id"], row["is_revisit"]),)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Rows(LINE).batches(records(batches), lambda row: len(row[0]))

    return write_lines(typed.mapInArrow(write, "line binary"), warc_path or shared_path(spark, "warc"), "\r\n\r\n")


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to ARC, convert to WARC and read back: one row for each page.

    page_id, payload_bytes, payload_digest (upper-case base32 SHA-1 of the full payload), record_type, refers_to,
    record_id, target_uri, date. An empty table gives no rows; null html is an empty payload.
    """
    spark = pages.sparkSession
    warc = arc_to_warc(spark, write_arc(pages), min_bytes=min_bytes)
    return read_warc(spark, warc, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "date"
    )
