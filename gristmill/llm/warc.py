"""WARC archives of pages: a writer whose records are gzip members of their own, and a reader that salvages damaged archives."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm._shared import map_batches, scratch_path, settle, sifted

VERSION = b"WARC/1.1"
_VERSION_LINE = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
_MAGIC = b"\x1f\x8b\x08"
#: Compressed bytes of a chunk that is written as one row, and chunks of a file.
CHUNK, CHUNKS_PER_FILE = 1 << 20, 16
_DATE = "2000-01-01T00:00:00Z"


class Record(NamedTuple):
    """A record as read: headers in lower case, its block, and where it lay in the archive."""

    headers: dict[str, str]
    block: bytes
    start: int
    end: int


class Gap(NamedTuple):
    """Bytes that are no valid record, quarantined."""

    start: int
    end: int
    reason: str


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _line(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record with the payload, or, where ``refers_to`` is given, a revisit record without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else str(page_id)
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", _line(url or "about:blank")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        headers[3:3] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[Record, int] | str:
    """The record that begins at ``at`` and where it ends, or what is wrong with it. Length, end and digest are checked."""
    if not _VERSION_LINE.match(data, at):
        return "no version line"
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return "headers do not end"
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "header without a colon"
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isascii() or not headers.get("content-length", "").isdigit():
        return "no content length"
    begin = stop + 4
    end = begin + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "block does not end where its length says"
    block = data[begin:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != payload_digest(block):
        return "block digest differs"
    payload = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and payload.startswith("sha1:") and payload[5:] != payload_digest(block.partition(b"\r\n\r\n")[2]):
        return "payload digest differs"
    return Record(headers, block, at, end + 4), end + 4


def _next(data: bytes, at: int) -> int:
    """Where the next gzip member or version line may begin."""
    line = _VERSION_LINE.search(data, at)
    found = [x for x in (data.find(_MAGIC, at), line.start() if line else -1) if x >= 0]
    return min(found, default=len(data))


def read_archive(data: bytes) -> Iterator[Record | Gap]:
    """Records in order, and gaps between them.

    Members and plain records may follow each other in one archive. Where a member or record fails a check, reading
    goes on at the next byte sequence that begins a valid one; what lies between is a gap with the first failure's
    reason. A member may hold several records: where one of these fails a check, the others are taken, found by their version
    lines, and a gap names the member. Of a member that does not unpack whole nothing is taken.
    """
    at, bad, reason = 0, -1, ""
    while at < len(data):
        records, end, failure = _at(data, at)
        if failure and not records:
            if bad < 0:
                bad, reason = at, failure
            at = _next(data, at + 1)
            continue
        if bad >= 0:
            yield Gap(bad, at, reason)
            bad = -1
        yield from records
        if failure:
            yield Gap(at, end, f"inside a member: {failure}")
        at = end
    if bad >= 0:
        yield Gap(bad, len(data), reason)


def _at(data: bytes, at: int) -> tuple[list[Record], int, str]:
    """The records at ``at``, where they end, and what is wrong there: with everything, or with some records of a member."""
    if data.startswith(b"WARC/", at):
        found = parse_record(data, at)
        return ([], at, found) if isinstance(found, str) else ([found[0]], found[1], "")
    if not data.startswith(_MAGIC, at):
        return [], at, "neither a member nor a version line"
    unpacker = zlib.decompressobj(31)
    parts, fed = [], at
    try:
        while not unpacker.eof and fed < len(data):
            parts.append(unpacker.decompress(data[fed : fed + (1 << 16)]))
            fed += 1 << 16
    except zlib.error as e:
        return [], at, f"member does not unpack: {e}"
    if not unpacker.eof:
        return [], at, "member is cut short"
    end = min(fed, len(data)) - len(unpacker.unused_data)
    inner, records, where, failure = b"".join(parts), [], 0, ""
    while where < len(inner):
        found = parse_record(inner, where)
        if isinstance(found, str):
            failure = failure or found
            line = _VERSION_LINE.search(inner, where + 1)
            where = line.start() if line else len(inner)
        else:
            records.append(found[0]._replace(start=at, end=end))
            where = found[1]
    return records, end, failure


def _chunks(rows: Iterator[bytes]) -> Iterator[bytes]:
    """Members joined into chunks, each without its last byte, which is zero and which the writer puts as line end.

    A member ends with its length, whose highest byte is zero below 16 MiB; a longer one is followed by an empty member.
    """
    empty = _member(b"")
    parts, size = [], 0
    for member in rows:
        parts.append(member)
        size += len(member)
        if size >= CHUNK:
            yield b"".join(parts if member[-1] == 0 else [*parts, empty])[:-1]
            parts, size = [], 0
    if parts:
        yield b"".join(parts if parts[-1][-1] == 0 else [*parts, empty])[:-1]


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one record per row of ``pages`` into archives below ``path``, through Spark's own committed writer.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes that with the smallest id is the response and the
    others revisit it; smaller ones are all responses. A null payload is empty. Rows that repeat the response's id are
    responses too; a null id is never referred to, and is a response where no other id has its payload.
    Payloads are read once for their digests, of which (id, digest) is shuffled, and once to be written. Digests that repeat
    are folded to a bounded number of values and broadcast: pages whose digest folds to none of these repeat nothing and are written
    where they are read; only the others are shuffled, with their payloads, to learn what they refer to.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    marked = rows.withColumn("sha", F.unhex(F.sha1(F.col("payload").cast("binary"))))
    keys = marked.where(F.octet_length("payload") >= min_revisit_bytes).select("page_id", "sha")
    first = keys.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    first = settle(first, "repeated")
    # Only rows of repeated payloads come here; a page's own digest tells apart rows that share an id.
    revisits = keys.join(first, "sha").where("first IS NOT NULL AND NOT page_id <=> first").select(F.col("page_id").alias("id"), "sha", F.col("first").alias("refers_to")).distinct()
    sieved = sifted(marked, ["sha"], first, "repeats")
    alone = sieved.where("NOT repeats").select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    shared = sieved.where("repeats").withColumnRenamed("sha", "own")
    planned = alone.union(shared.join(revisits, shared.page_id.eqNullSafe(revisits.id) & (shared.own == revisits.sha), "left").select("page_id", "url", "payload", "refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members():
            for batch in batches:
                ids, urls, refers = batch.column(0).to_pylist(), batch.column(1), batch.column(3).to_pylist()
                payload = batch.column(2)
                for i in range(batch.num_rows):
                    yield _member(record_bytes(ids[i], urls[i].as_py(), payload[i].as_buffer().to_pybytes(), refers[i]))

        for chunk in _chunks(members()):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], type=pa.binary())], names=["value"])

    chunks = map_batches(planned, run, "value binary").select(F.col("value").cast("string").alias("value"))
    chunks.write.option("lineSep", "\x00").option("maxRecordsPerFile", CHUNKS_PER_FILE).text(path)


_RECORDS = "archive string, start long, end long, record_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary, gap_reason string"
_BARE = re.compile(r"^<?(?:urn:page:)?(.*?)>?$")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record and every quarantined gap of the archives below ``path``; gaps have a ``gap_reason`` and nothing else but their place.

    An archive is read by one task as one value, so archives must be of bounded size, as the writer's are; Spark reads
    files of up to 2 GB so. Empty folders' archives give no rows; several archives may hold the same records, which are rows of their own.
    A revisit's payload size is that of its HTTP header; its payload is null. Damage never ends the read.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer().to_pybytes()
                out, size = [], 0
                for item in read_archive(data):
                    out.append(_row(name, item, with_payload))
                    size += len(out[-1][9] or b"")
                    if len(out) >= 2000 or size >= 8 << 20:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

    return map_batches(files, run, _RECORDS)


def _row(name: str, item: Record | Gap, with_payload: bool) -> tuple:
    if isinstance(item, Gap):
        return (name, item.start, item.end, None, None, None, None, None, None, None, item.reason)
    head, _, payload = item.block.partition(b"\r\n\r\n")
    kind = item.headers.get("warc-type")
    size = len(payload)
    if kind == "revisit":
        stated = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
        size = int(stated[1]) if stated else None
    refers = item.headers.get("warc-refers-to")
    digest = item.headers.get("warc-payload-digest", "").removeprefix("sha1:")
    return (name, item.start, item.end, kind, _BARE.match(item.headers.get("warc-record-id", ""))[1], item.headers.get("warc-target-uri"), digest, size, refers and _BARE.match(refers)[1], payload if with_payload and kind == "response" else None, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [part.split(" ")[0] for part in _RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def archive_pages(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages and read the archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` per record.

    Null ids and payloads come back as such and as empty; payloads may be of any length; repeated rows are records of their own; an
    empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes)
    records = read_archives(spark, path, with_payload=False).where("gap_reason IS NULL")
    number = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
