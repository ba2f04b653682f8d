"""WARC archives (operator 11): pages written as records, and archives read back by segment reassembly.

Writing. A page is a response record whose block is an HTTP message with chunked transfer framing. Of the pages with one payload only the
least ``page_id`` has it written; the others are revisit records that name it. A block longer than ``SEGMENT`` is cut: the first part is the
response, the others are continuation records with the origin's id and a segment number, the last with the total length. Records are rows of
Spark's text writer, so files appear only when their task has committed, in any store that Spark writes to, and a file holds at most ``FILE_RECORDS``
records; no record is longer than a segment and its header, so the size of a file is bounded whatever the pages are like.

Reading. Files are parsed in their tasks. Whole records are decoded on the spot; only parts travel, grouped by origin id and
ordered by segment number. A group is one page. Numbers must run from 1 without a gap, lengths must add up to the total, the chunked
framing must end properly, and the payload must have the digest its header says; else the row says what is wrong.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import blocks, byte_column, written

SEGMENT = 32 << 10
CHUNK = 8 << 10
FILE_RECORDS = 4096
#: Payloads with more pages than this meet their first page by broadcast: they are at most one for as many pages.
HOT = 100_000
DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in base32: forty bits of it are ten hex digits and eight of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def _first_pages(pages: DataFrame) -> DataFrame:
    """page_id, digest, first and repeated of pages that are not the only row of their payload."""
    known = written(pages.where(F.col("page_id").isNotNull()).groupBy("page_id", "digest").agg(F.count("*").alias("rows")), "page-digests")
    shared = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("pages"))
    shared = written(shared.where(F.col("pages") > 1), "shared-payloads")
    hot = F.broadcast(shared.where(F.col("pages") > HOT).select("digest", "first"))
    cold = known.join(hot, "digest", "left_anti").join(shared.where(F.col("pages") <= HOT).select("digest", "first"), "digest", "left")
    both = cold.unionByName(known.join(hot, "digest"))
    both = both.select("page_id", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"), (F.col("rows") > 1).alias("repeated"))
    return written(both.where(F.col("refers_to").isNotNull() | F.col("repeated")), "page-roles")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _uri(url: str | None, record: str) -> str:
    """The page's address without what would end a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else record


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, row: int | None, date: str, segment: int) -> list[bytes]:
    """The records of one page: a revisit, a response, or a response and its continuations."""
    record = f"urn:page:{'' if page_id is None else page_id}:{digest}" + ("" if row is None else f":{row}")
    same = [("WARC-Date", date), ("WARC-Target-URI", _uri(url, record))]
    about = [*same, ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page_id), ("X-Payload-Length", len(payload))]
    if refers_to is not None:
        to = [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>"), ("X-Refers-To-Page-ID", refers_to)]
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record}>"), *about, *to], _HTTP)]
    block = _HTTP + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{record}>"), *about]
    if len(block) <= segment:
        return [_record(first, block)]
    out, n = [_record([*first, ("WARC-Segment-Number", 1)], block[:segment])], 1
    for at in range(segment, len(block), segment):
        n += 1
        total = len(block) if at + segment >= len(block) else None
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record}:segment-{n}>"), *same, ("WARC-Segment-Origin-ID", f"<{record}>"), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)]
        out.append(_record(fields, block[at : at + segment]))
    return out


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE, segment: int = SEGMENT) -> None:
    """Write ``pages`` as gzipped WARC files below ``path``.

    A null payload is an empty one. Of rows with equal payloads those with the least page_id are responses (several if that id
    is repeated), the others revisit it. A row with a null page_id is a response and is never referred to. Repeated rows get
    a record each, told apart by a number in the record's id; references leave that number out. An empty table writes no record.
    """
    html = F.coalesce(pages[html_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), html.alias("html"), payload_digest(html).alias("digest"))
    roles = _first_pages(rows.select("page_id", "digest"))
    both = rows.withColumn("row", F.monotonically_increasing_id()).join(roles, ["page_id", "digest"], "left")
    row = F.when(F.col("page_id").isNull() | F.col("repeated"), F.col("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "html"):
            plain = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            payloads = byte_column(batch.column(2)).to_pylist()
            made = [r for (i, u, d, to, n), p in zip(zip(*plain), payloads) for r in page_records(i, u, p, d, to, n, date, segment)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    records = both.select("page_id", "url", "html", "digest", "refers_to", row.alias("row")).mapInArrow(run, "record binary")
    # A record ends with two line ends, which is what separates the rows.
    out = records.select(F.col("record").cast("string").alias("value")).write
    out.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def records_of(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record of a plain or gzipped archive."""
    source = io.BytesIO(archive)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=source)) if archive[:2] == b"\x1f\x8b" else source
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        fields, name = {}, ""
        while (line := stream.readline().decode("utf-8", "replace").rstrip("\r\n")) != "":
            if line[0] in " \t" and name:
                fields[name] += " " + line.strip()
            else:
                name, _, value = line.partition(":")
                name = name.strip().lower()
                fields[name] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("an archive ends inside a record")
        yield fields, block


def payload_of(block: bytes) -> bytes:
    """Body of an HTTP message, without chunked framing where the header names it."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the HTTP header")
    if not re.search(rb"^transfer-encoding:[^\r\n]*\bchunked\b", head, re.I | re.M):
        return body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no end of a chunk's header")
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is not as long as its header says")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _decoded(block: bytes, digest: str | None) -> tuple[int | None, str | None, bytes | None, str | None]:
    """Length, digest and bytes of a payload, and what is wrong with it."""
    try:
        payload = payload_of(block)
    except ValueError as exc:
        return None, None, None, f"framing: {exc}"
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest is not None and found != digest:
        return None, None, None, f"digest {found} instead of {digest}"
    return len(payload), found, payload, None


_PARSED = (
    "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, problem string, "
    "segment int, total long, block binary"
)
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, problem string"


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _number(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if name in fields else None


def _parsed(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, record = fields.get("warc-type"), fields.get("warc-record-id")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    known = (_number(fields, "x-page-id"), fields.get("warc-target-uri"), kind, _number(fields, "x-refers-to-page-id"))
    segment, total = _number(fields, "warc-segment-number"), _number(fields, "warc-segment-total-length")
    if segment is not None:
        return (fields.get("warc-segment-origin-id", record), *known, None, digest, None, None, segment, total, block)
    if kind == "revisit":
        return (record, *known, _number(fields, "x-payload-length"), digest, None, None, None, None, None)
    size, found, payload, problem = _decoded(block, digest)
    return (record, *known, size, found or digest, payload if with_payload else None, problem, None, None, None)


def _assembled(group: list[dict], with_payload: bool) -> tuple:
    """One record of the parts of an origin, which are ordered by segment number."""
    first, last = group[0], group[-1]
    known = (first["page_id"], first["url"], first["record_type"], first["refers_to"])
    problem = None
    if [g["segment"] for g in group] != list(range(1, len(group) + 1)):
        problem = f"segments {[g['segment'] for g in group][:20]}"
    elif last["total"] is None:
        problem = "no total length: the last segment is missing"
    elif sum(len(g["block"]) for g in group) != last["total"]:
        problem = f"{sum(len(g['block']) for g in group)} bytes instead of {last['total']}"
    if problem:
        return (*known, None, first["payload_digest"], None, problem)
    size, found, payload, problem = _decoded(b"".join(g["block"] for g in group), first["payload_digest"])
    return (*known, size, found or first["payload_digest"], payload if with_payload else None, problem)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (if asked) and problem of every record.

    A revisit has the digest and length that its header states and no payload. What cannot be put together or decoded keeps its row, with
    null length and payload, and ``problem`` says why. An empty folder gives an empty table.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                held, size = [], 0
                for fields, block in records_of(archive.as_py()):
                    if fields.get("warc-type") in ("response", "revisit", "continuation"):
                        held.append(_parsed(fields, block, with_payload))
                        size += len(block)
                    if len(held) == 4096 or size > 4 << 20:
                        yield _rows(held, _PARSED)
                        held, size = [], 0
                if held:
                    yield _rows(held, _PARSED)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in blocks(batches, "block"):
            out = []
            for part in batch.to_pylist():
                if group and part["record_id"] != group[0]["record_id"]:
                    out.append(_assembled(group, with_payload))
                    group = []
                group.append(part)
            yield _rows(out, _RECORD)
        if group:
            yield _rows([_assembled(group, with_payload)], _RECORD)

    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")
    parsed = written(files.mapInArrow(parse, _PARSED), "warc-records")
    whole = parsed.where(F.col("segment").isNull()).select(*[c.split()[0] for c in _RECORD.split(", ")])
    parts = parsed.where(F.col("segment").isNotNull()).select(
        "record_id", "page_id", "url", "record_type", "refers_to", "payload_digest", "segment", "total", "block"
    )
    # A group is the parts of one page, which was one value before.
    joined = parts.repartition("record_id").sortWithinPartitions("record_id", "segment").mapInArrow(assemble, _RECORD)
    return whole.unionByName(joined)


def unresolved(records: DataFrame) -> DataFrame:
    """refers_to, payload_digest and payload_bytes of revisits whose response is not among the records, or differs."""
    asked = records.where(F.col("record_type") == "revisit").select(F.col("refers_to").alias("page_id"), "payload_digest", "payload_bytes").distinct()
    there = records.where((F.col("record_type") == "response") & F.col("problem").isNull()).select("page_id", "payload_digest", "payload_bytes")
    return asked.join(there, ["page_id", "payload_digest", "payload_bytes"], "left_anti").withColumnRenamed("page_id", "refers_to")
