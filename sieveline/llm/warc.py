"""WARC archives as a chunked record table.

A record is rows (record, chunk): chunk 0 holds its headers, the next ones slices
of its payload, so no task ever holds more of a payload than its source row and
one slice.  Each row carries the SHA-1 of the payload so far.  The rows of an
archive in order, decompressed and laid end to end, are a WARC/1.1 file.

A stored payload's record is named by its digest: slices from any page that has
the payload serve, each task sends them once, and pages that revisit it send none.
So a payload that a third of all pages have is no hotter than any other.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import shared

SLICE, LEVEL = 256 << 10, 6
#: Payloads of fewer bytes are always stored.
MIN_REVISIT = 0
DATE = "2024-01-01T00:00:00Z"
# The revisit profile that the WARC 1.1 standard names.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TABLE = "record string, chunk int, body binary, sha1_so_far string"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_FACTS = "page_id long, url string, payload_bytes long, payload_digest string, payload binary"


def _base32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def _payloads(column: pa.ChunkedArray):
    """Views of the values, without copies; null: empty."""
    for value in column.cast(pa.large_binary()).chunks if isinstance(column, pa.ChunkedArray) else [column.cast(pa.large_binary())]:
        for v in value:
            yield memoryview(v.as_buffer()) if v.is_valid else memoryview(b"")


def _slices(payload: memoryview, size: int):
    for a in range(0, len(payload), size):
        yield payload[a : a + size]


def facts(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, payload) of each page; the payload only of fewer bytes than ``min_revisit``."""

    def digest(tables):
        for t in tables:
            rows = []
            for payload in _payloads(t.column("html")):
                rows.append((len(payload), _base32(hashlib.sha1(payload)), bytes(payload) if len(payload) < min_revisit else None))
            sizes, digests, small = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([t.column("page_id"), t.column("url"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(small, pa.binary())], ["page_id", "url", "payload_bytes", "payload_digest", "payload"])

    return pages.select("page_id", "url", "html").mapInArrow(digest, _FACTS)


def _header(record: dict) -> bytes:
    """WARC and HTTP headers of a record."""
    clean = lambda s: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s or "")
    n = record["payload_bytes"]
    # a page's number, and what tells its records apart where numbers repeat or are missing
    name = lambda page, key: f"<urn:page:{'' if page is None else page}:{hashlib.sha1(key.encode()).hexdigest()[:20]}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    revisit = record["record_type"] == "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(record['page_id'], record['record'])}", f"WARC-Date: {DATE}"]
    if record["url"]:
        lines.append(f"WARC-Target-URI: {clean(record['url'])}")
    lines += [f"WARC-Payload-Digest: sha1:{record['payload_digest']}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(record['refers_to'], record['payload_digest'])}"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else n)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT, slice_bytes: int = SLICE) -> DataFrame:
    """The chunked record table, each partition an archive with its rows in order.

    Of pages with equal payloads of at least ``min_revisit`` bytes that with the
    smallest page_id (null: the largest; ties: the smallest url, then any one) is a
    response and the others revisit it; smaller payloads are all responses.  Null
    html is an empty payload; a null url is left out; repeated rows are records of
    their own; an empty table gives none; extra columns are not read, whatever their
    names.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    known = facts(source, min_revisit).groupBy("page_id", "url", "payload_bytes", "payload_digest", "payload").agg(F.count("*").alias("times"))
    rank = F.struct(F.col("page_id").isNull().alias("null"), F.col("page_id").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.col("url").isNull().alias("no_url"))
    first = known.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min(rank).alias("first"))
    each = known.join(first, "payload_digest", "left").select("*", rank.alias("own"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"))
    revisit = F.col("first").isNotNull() & ~((F.col("own") == F.col("first")) & (F.col("nth") == 1))
    heads = each.select(
        F.when(revisit | F.col("first").isNull(), F.concat_ws(":", "payload_digest", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce("url", F.lit("")), F.col("nth").cast("string"))).otherwise(F.col("payload_digest")).alias("record"),
        "page_id",
        "url",
        "payload_bytes",
        "payload_digest",
        "payload",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.page_id")).alias("refers_to"),
    )

    def head_rows(tables):
        for t in tables:
            rows = [(r["record"], 0, _header(r) + (r["payload"] or b""), None) for r in t.to_pylist()]
            yield _batch(rows)

    def slice_rows(tables):
        squeeze, sent = zstandard.ZstdCompressor(level=LEVEL), set()
        for t in tables:
            for payload in _payloads(t.column("html")):
                digest = _base32(hashlib.sha1(payload))
                if len(payload) < min_revisit or digest in sent:
                    continue
                sent.add(digest)
                sha1, rows = hashlib.sha1(), []
                for k, part in enumerate(_slices(payload, slice_bytes), 1):
                    sha1.update(part)
                    rows.append((digest, k, squeeze.compress(part), _base32(sha1)))
                    if len(rows) >= 16:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def archive(tables):
        """In order of (record, chunk): slices that several tasks sent are taken once, a record's end is added."""
        squeeze, last = zstandard.ZstdCompressor(level=LEVEL), None
        for t in tables:
            rows = []
            for record, chunk, body, sha1 in zip(*(t.column(c).to_pylist() for c in ("record", "chunk", "body", "sha1_so_far"))):
                if last == (record, chunk):
                    continue
                if chunk == 0:
                    if last is not None:
                        rows.append((last[0], last[1] + 1, squeeze.compress(b"\r\n\r\n"), None))
                    body = squeeze.compress(body)
                rows.append((record, chunk, body, sha1))
                last = (record, chunk)
            if rows:
                yield _batch(rows)
        if last is not None:
            yield _batch([(last[0], last[1] + 1, squeeze.compress(b"\r\n\r\n"), None)])

    slices = source.select("html").mapInArrow(slice_rows, TABLE)
    return heads.mapInArrow(head_rows, TABLE).unionByName(slices).repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(archive, TABLE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int32(), pa.binary(), pa.string()))], ["record", "chunk", "body", "sha1_so_far"])


class Parser:
    """Incremental WARC reader: feed it bytes in order, it returns the records that end in them."""

    def __init__(self):
        self.pending = b""
        self.head: dict | None = None
        self.left = 0
        self.http = False

    def feed(self, data) -> list[dict]:
        out = []
        self.pending = self.pending + bytes(data) if self.pending else data
        while True:
            if self.head is None:
                buffer = bytes(self.pending).lstrip(b"\r\n")
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    self.pending = buffer
                    return out
                version, *lines = buffer[:end].decode().split("\r\n")
                if not version.startswith("WARC/"):
                    raise ValueError(f"no WARC record here: {version[:40]!r}")
                self.head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
                self.left = int(self.head["content-length"])
                self.http, self.size, self.sha1, self.http_head = True, 0, hashlib.sha1(), b""
                self.pending = buffer[end + 4 :]
            if self.http:
                block = bytes(self.pending[: self.left])
                end = block.find(b"\r\n\r\n")
                if end < 0 and len(block) < self.left:
                    return out
                end = end + 4 if end >= 0 else len(block)
                self.http_head, self.http = block[:end], False
                self.left -= end
                self.pending = self.pending[end:]
            part = self.pending[: self.left]
            self.sha1.update(part)
            self.size += len(part)
            self.left -= len(part)
            self.pending = self.pending[len(part) :]
            if self.left:
                return out
            out.append(self._record())
            self.head = None

    def _record(self) -> dict:
        head, number = self.head, lambda s: int(m[1]) if (m := re.search(r"urn:page:(-?\d+):", s or "")) else None
        told = head["warc-payload-digest"].removeprefix("sha1:")
        revisit = head["warc-type"] == "revisit"
        size = int(m[1]) if revisit and (m := re.search(rb"(?i)content-length: *(\d+)", self.http_head)) else self.size
        if not revisit and _base32(self.sha1) != told:
            raise ValueError(f"the payload of {head['warc-record-id']} differs from its digest")
        return {"page_id": number(head["warc-record-id"]), "payload_bytes": size, "payload_digest": told, "record_type": head["warc-type"], "refers_to": number(head.get("warc-refers-to"))}


def read(table: DataFrame) -> DataFrame:
    """Parse a chunked record table: one row per record, payloads verified while they stream by."""

    def parse(tables):
        parser, unsqueeze = Parser(), zstandard.ZstdDecompressor()
        for t in tables:
            found = [r for body in t.column("body").to_pylist() for r in parser.feed(unsqueeze.decompress(body))]
            if found:
                yield pa.RecordBatch.from_pylist(found, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return table.select("record", "chunk", "body").repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(parse, RESULT)


def write(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write the archives of ``pages`` as a chunked record table."""
    records(pages, min_revisit).write.option("compression", "zstd").parquet(path)


def stream(spark: SparkSession, path: str):
    """The bytes of the archives at ``path``, in pieces, to copy them out as a plain WARC file."""
    unsqueeze = zstandard.ZstdDecompressor()
    for row in spark.read.parquet(path).orderBy("record", "chunk").select("body").toLocalIterator():
        yield unsqueeze.decompress(bytes(row.body))


def round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write archives into the shared folder and read them back: one row per page."""
    spark = pages.sparkSession
    path = shared.new_path(spark, "warc")
    write(pages, path, min_revisit)
    return read(spark.read.schema(TABLE).parquet(path))
