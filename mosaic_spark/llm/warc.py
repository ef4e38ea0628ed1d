"""WARC archives of pages: writer, and a salvage reader for damaged files.

The writer composes records in SQL, compresses each to a gzip member and lets Spark's
text sink write them, so an archive goes wherever Spark can write. A payload that several pages share is stored once; the others are revisit
records that refer to it.

The reader frames records by their own lengths and checks version line, header,
length, terminator and payload digest. After a failed check it searches for the
next gzip member or version line from there, goes on, and logs the bytes in
between as a quarantined gap. The bytes of a gzip member are searched in the same way
once decompressed, as far as a cut or damaged stream gives them."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

END = b"\r\n\r\n"
#: Records of an archive at most; with Spark's partition size this bounds a file.
ARCHIVE_RECORDS = 10_000
SCHEMA = "archive string, start long, stop long, status string, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: 40 hex digits in groups of 5 are 4 base32 digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _with_reference(pages: DataFrame, page_id: str, html: str, least_bytes: int) -> DataFrame:
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload").cast("binary")), "content": F.unhex(F.sha2(F.col("payload").cast("binary"), 256))})
    # payloads are equal by SHA-256 and length; who refers to whom is found without them
    named = rows.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= least_bytes)).select("page_id", "content", "payload_bytes")
    groups = named.groupBy("content", "payload_bytes").agg(F.max("page_id").alias("keep"), F.min("page_id").alias("least")).where("least < keep").drop("least")
    refers = named.join(groups, ["content", "payload_bytes"]).where("page_id < keep").select("page_id", "content", F.col("keep").alias("refers_to")).distinct()
    return rows.join(refers, ["page_id", "content"], "left").drop("content")


#: The shortest gzip member, of no bytes: written between records as the text sink's
#: line separator, so that a file is nothing but gzip members.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A gzip member of every (header, block) record."""
    for b in batches:
        for i in range(0, len(b), 500):
            part, out = b.slice(i, 500), []
            for head, block in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.append(z.compress(head.encode() + block.encode() + END) + z.flush())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def _header(fields: list[tuple[str, Column]]) -> Column:
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\r\n"))).otherwise("") for k, v in fields]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", html: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> str:
    """Writes a record per row below ``path`` and returns it.

    Payloads equal and of at least ``least_bytes``: the largest page_id is the
    response, smaller ones are revisits without a block. Null html is an empty
    payload; a null page_id or url leaves its field out and such a row is always a
    response; rows repeating the response's id are responses too."""
    rows = _with_reference(pages, page_id, html, least_bytes)
    again = F.col("refers_to").isNotNull()
    block = F.when(again, F.lit("")).otherwise(F.col("payload"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    fields = [
        ("WARC-Type", F.when(again, "revisit").otherwise("response")),
        ("WARC-Record-ID", name("page_id")),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("X-Payload-Length", F.col("payload_bytes")),
        ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", name("refers_to")),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.octet_length(block)),
    ]
    members = rows.select(_header(fields).alias("head"), block.alias("block")).mapInArrow(_members, "member binary")
    lines = members.select(F.col("member").cast("string").alias("value")).write
    lines.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)
    return path


#: A record cut short may leave the next version line inside a line.
_NEXT = re.compile(rb"WARC/1\.[01]\r\n(?=[!-9;-~]+:)|\x1f\x8b\x08")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n(?=[!-9;-~]+:)")
#: Compressed bytes that a member takes at a time.
_STEP = 1 << 16
_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\Z")


def _frame(data: bytes, at: int) -> tuple[dict, int, int] | None:
    """(fields, block start, end after the terminator) of the record at ``at``."""
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), at):
        return None
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None
    fields = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        m = _FIELD.match(line)
        if not m:
            return None
        fields[m[1].decode("ascii").lower()] = m[2].decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")) or "warc-type" not in fields:
        return None
    start = head + 4
    end = start + int(fields["content-length"])
    return (fields, start, end + 4) if data.startswith(b"\r\n\r\n", end) else None


def salvage(data: bytes) -> Iterator[tuple[int, int, str, dict, bytes]]:
    """(start, stop, status, fields, payload) of every record and gap, in order.

    status is "ok", "digest" (framing held, payload digest did not: the bytes are
    quarantined), "unverified" (a record without a digest in a damaged gzip stream) or
    "gap" (bytes skipped until the next member or version line). Offsets of records and
    gaps inside a gzip member are those of the member. An empty file has none."""
    at, n, bad = 0, len(data), None
    while at < n:
        got, end = [], None
        if data.startswith(b"\x1f\x8b\x08", at):
            plain, end, damaged = _member(data, at)
            got = [(s, f, p) for _, _, s, f, p in _plain(plain, damaged)]
            if end is not None and not plain:
                got, at = [], end
                if bad is not None:
                    yield bad, at, "gap", {}, b""
                    bad = None
                continue
            if not any(f for _, f, _ in got):
                got = []
            elif end is None and got[-1][0] != "gap":
                got.append(("gap", {}, b""))
        elif frame := _frame(data, at):
            status, fields, payload, end = _record(data, at, frame, False)
            got = [(status, fields, payload)]
        if end is None:
            m = _NEXT.search(data, at + 1)
            end = m.start() if m else n
        if not got:
            bad = at if bad is None else bad
        elif bad is not None:
            yield bad, at, "gap", {}, b""
            bad = None
        for status, fields, payload in got:
            yield at, end, status, fields, payload
        at = end
    if bad is not None:
        yield bad, n, "gap", {}, b""


def _plain(data: bytes, damaged: bool) -> Iterator[tuple[int, int, str, dict, bytes]]:
    """Records and gaps of uncompressed bytes."""
    at, n, bad = 0, len(data), None
    while at < n:
        frame = _frame(data, at)
        if frame is None:
            bad = at if bad is None else bad
            m = _VERSION.search(data, at + 1)
            at = m.start() if m else n
            continue
        if bad is not None:
            yield bad, at, "gap", {}, b""
            bad = None
        status, fields, payload, end = _record(data, at, frame, damaged)
        yield at, end, status, fields, payload
        at = end
    if bad is not None:
        yield bad, n, "gap", {}, b""


def _record(data: bytes, at: int, frame: tuple[dict, int, int], damaged: bool) -> tuple[str, dict, bytes, int]:
    """(status, fields, payload, end). A record whose digest fails may have a wrong length:
    it ends where a sound record begins inside it."""
    fields, start, end = frame
    payload = data[start : end - 4]
    status = _checked(fields, payload)
    if status == "digest":
        for m in _VERSION.finditer(data, start, end):
            inner = _frame(data, m.start())
            if inner and _checked(inner[0], data[inner[1] : inner[2] - 4]) == "ok":
                return status, fields, data[start : m.start()], m.start()
    elif damaged and (fields["warc-type"] == "revisit" or not fields.get("warc-payload-digest", "").lower().startswith("sha1:")):
        status = "unverified"
    return status, fields, payload, end


def _member(data: bytes, at: int) -> tuple[bytes, int | None, bool]:
    """(bytes, end, damaged) of the gzip member at ``at``: all that its stream gives.
    end is None where the stream is cut or damaged."""
    z, out, view, i = zlib.decompressobj(31), [], memoryview(data), at
    try:
        while not z.eof and i < len(data):
            out.append(z.decompress(view[i : i + _STEP]))
            i += _STEP
    except zlib.error:
        # once more, byte by byte where it fails
        z, out = zlib.decompressobj(31), []
        try:
            for j in range(at, i, _STEP):
                out.append(z.decompress(view[j : j + _STEP]))
            for j in range(i, min(i + _STEP, len(data))):
                out.append(z.decompress(view[j : j + 1]))
        except zlib.error:
            pass
        return b"".join(out), None, True
    return b"".join(out), min(i, len(data)) - len(z.unused_data) if z.eof else None, False


def _checked(fields: dict, payload: bytes) -> str:
    digest = fields.get("warc-payload-digest", "")
    if fields["warc-type"] == "revisit" or not digest.lower().startswith("sha1:"):
        return "ok"
    return "ok" if digest[5:] == base64.b32encode(hashlib.sha1(payload).digest()).decode() else "digest"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record and quarantined gap below ``path``, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
        for b in batches:
            for archive, content in zip(b.column(0), b.column(1)):
                rows, held = [], 0
                for start, stop, status, f, payload in salvage(content.as_py()):
                    kind = f.get("warc-type")
                    size = int(f["x-payload-length"]) if kind == "revisit" and f.get("x-payload-length", "").isdigit() else len(payload)
                    rows.append((archive.as_py(), start, stop, status, kind, f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("warc-payload-digest", "")[5:] or None, size if kind else None, payload if kind else None))
                    held += len(payload)
                    if held > 8_000_000 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives on the shared folder, reads them back and
    returns what the archives say of every page."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records = read_archives(spark, write_archives(pages, path)).where("status = 'ok'")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return records.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", number(F.col("refers_to"))).alias("refers_to"))
