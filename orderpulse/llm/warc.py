"""WARC archives: a writer with revisit records and a salvaging reader.

Writer: one record per page, each its own gzip member, written through Spark's
text writer (binary value, an empty gzip member as separator), so commits and
retries are Spark's. Of records with equal payloads of at least ``least`` bytes
the one with the largest page id is the response; the others are revisit
records that refer to it and carry no payload.

Reader: each file is read member by member (or record by record, if it is not
compressed). A record counts if its member's checksum, its header, its block
length, its end mark and its payload digest hold. After a failed check the
reader searches for the next position where a valid member or version line
starts, goes on from there, and logs the skipped bytes as a gap. A file is one
row of Spark's binary source (below 2 GB); the writer starts a new file every
``records_per_file`` records.

Defined results: null html is an empty payload; a null page id is kept as null;
rows equal in page id and payload are alike (all responses or all revisits); a
revisit whose response was lost keeps its digest and has null payload bytes; an
empty table gives an archive without records; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ID = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_RECORD = ("file string, begin long, end long, kind string, page_id long, refers_to long, "
           "payload_digest string, url string, payload binary, reason string")
_STARTS = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_CHUNK = 1 << 16


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One uncompressed record; ``refers_to`` given: a revisit without payload. ``refers_to`` is (page id,) or None."""
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: <{_ID}{'' if refers_to[0] is None else refers_to[0]}>", f"WARC-Profile: {_PROFILE}"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _records(date: str, compress: bool):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = []
                for page, url, payload, digest, revisit, top in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    raw = record_bytes(page, url, payload, digest, (top,) if revisit else None, date)
                    out.append(gzip.compress(raw, 6, mtime=0) if compress else raw)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
    return run


def write(pages: DataFrame, path: str, least: int = 1000, date: str = "2024-01-01T00:00:00Z",
          compress: bool = True, records_per_file: int = 50_000) -> None:
    """Write ``pages(page_id, url, html)`` as an archive folder."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = (rows.where(F.octet_length("payload") >= least).groupBy("digest")
              .agg(F.max("page_id").alias("top"), F.count("*").alias("many")).where("many > 1")
              .select(F.col("digest").alias("d"), "top"))
    joined = rows.join(groups, F.col("digest") == F.col("d"), "left")
    revisit = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    records = joined.select("page_id", "url", "payload", "digest", revisit.alias("revisit"), "top").mapInArrow(
        _records(date, compress), "record binary")
    options = {"lineSep": _EMPTY_MEMBER.decode("latin-1"), "encoding": "ISO-8859-1"} if compress else {
        "lineSep": "\r\n"}  # blank lines between records are allowed
    (records.select(F.col("record").cast("string").alias("value")).write
     .options(maxRecordsPerFile=records_per_file, **options).text(path))


def _page(value: str | None):
    digits = (value or "").strip("<>").removeprefix(_ID)
    return int(digits) if digits.lstrip("-").isdigit() else None


def parse_record(data, at: int):
    """``(end, fields)`` of the record that starts at ``at``; raises ValueError when a check fails."""
    stop = data.find(b"\r\n\r\n", at, at + (1 << 20))
    if not data.startswith(b"WARC/1.", at) or stop < 0:
        raise ValueError("no record header")
    head = {}
    for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("bad header line")
        head[name.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdigit() or "warc-type" not in head:
        raise ValueError("incomplete header")
    begin = stop + 4
    end = begin + int(head["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError("block length does not hold")
    payload = bytes(data[begin:end])
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:").lower()
    kind = head["warc-type"].lower()
    if digest and kind != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("payload digest does not hold")
    return end + 4, (kind, _page(head.get("warc-record-id")), _page(head.get("warc-refers-to")), digest,
                     head.get("warc-target-uri"), payload)


def parse_member(data: bytes, at: int):
    """``(end, records)`` of the gzip member that starts at ``at``."""
    d, out, pos, view = zlib.decompressobj(31), [], at, memoryview(data)
    try:
        while not d.eof:
            if pos >= len(data):
                raise ValueError("member is cut off")
            out.append(d.decompress(view[pos:pos + _CHUNK]))
            pos += _CHUNK
    except zlib.error as e:
        raise ValueError("member checksum does not hold") from e
    end = min(pos, len(data)) - len(d.unused_data)
    text, records, k = b"".join(out), [], 0
    while k < len(text):
        k, fields = parse_record(text, k)
        records.append(fields)
    return end, records


def salvage(data: bytes):
    """Every valid record as ``(begin, end, fields)`` and every gap as ``(begin, end, reason)``, in file order."""
    at, n, gap = 0, len(data), None
    while at < n:
        try:
            if data.startswith(b"\x1f\x8b\x08", at):
                end, records = parse_member(data, at)
            elif data.startswith(b"WARC/1.", at):
                end, fields = parse_record(data, at)
                records = [fields]
            elif data.startswith(b"\r\n", at) and gap is None:
                at += 2  # blank lines between plain records
                continue
            else:
                raise ValueError("no member or version line")
        except ValueError as e:
            gap = gap or (at, str(e))
            found = _STARTS.search(data, at + 1)
            at = found.start() if found else n
            continue
        if gap:
            yield gap[0], at, gap[1]
            gap = None
        for fields in records:
            yield at, end, fields
        at = end
    if gap:
        yield gap[0], n, gap[1]


def _reader(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows, size = [], 0
            for begin, end, x in salvage(content.as_buffer().to_pybytes()):
                if isinstance(x, str):
                    rows.append((path, begin, end, "gap", None, None, None, None, None, x))
                else:
                    kind, page, refers, digest, url, payload = x
                    rows.append((path, begin, end, kind, page, refers, digest, url, payload, None))
                    size += len(payload)
                if size > 4 << 20 or len(rows) >= 4096:
                    yield _to_batch(rows)
                    rows, size = [], 0
            yield _to_batch(rows)


def _to_batch(rows):
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(),
             pa.binary(), pa.string())
    names = [x.split()[0] for x in _RECORD.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of an archive folder: ``file, begin, end, kind`` (a WARC type, or ``gap`` with its
    ``reason``), ``page_id, refers_to, payload_digest, url, payload``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_reader, _RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` per record: revisits take their
    payload's size from the response that they refer to. ``records`` has ``payload_bytes``."""
    r = records.where("kind in ('response', 'revisit')")
    held = (r.where("kind = 'response'").select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"),
                                                F.col("payload_bytes").alias("n")).distinct())
    back = r.where("kind = 'revisit'").join(
        held, F.col("refers_to").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")), "left")
    own = r.where("kind = 'response'").select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
                                              F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(back.select("page_id", F.col("n").alias("payload_bytes"), "payload_digest",
                                       F.col("kind").alias("record_type"), "refers_to"))
