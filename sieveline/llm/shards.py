"""Asking the whole corpus about hashes, one bit per answer.

Documents are dealt into shards of bounded size by a hash of their id.  A shard
posts sorted sets of values, dealt into buckets by the values' leading bits; a
bucket sees each value once per shard at most (a key held by a third of all rows
is no hotter than any other) and answers every shard with one bit per value, in
the order it was posted.  A later pass over the shard derives the same sorted set
again and reads the answers.  The shuffle that deals the texts out is the same in
every pass, so Spark runs it once and reuses it; all state is lineage, so lost
executors cost only recomputation.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Posts go to buckets, replies to shards.
POST = "bucket long, shard long, n long, body binary"
REPLY = "shard long, kind int, bucket long, n long, body binary"
_POST = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
_REPLY = pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])


def plan_shards(docs: DataFrame, text: str, shard_bytes: int) -> tuple[int, int]:
    """Number of shards for texts of this total size, and bits of the bucket number."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    n = max(1, math.ceil(total / shard_bytes))
    return n, max(0, math.ceil(math.log2(n)))


def deal(docs: DataFrame, n: int, keep: tuple[str, ...] = (), by_text: bool = True) -> DataFrame:
    """(shard, doc_id, text and the columns to ``keep``): null texts count as empty; each row stays a row.

    The text counts as well as the id, so that rows with one id, or none, spread; not
    so where the id alone must tell the shard.
    """
    keys = ("doc_id", "text") if by_text else ("doc_id",)
    number = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("long")
    return docs.select(number.alias("shard"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep)


def in_order(table: pa.Table) -> pa.Table:
    """A shard's rows by id and text: a shuffle brings them in another order each time, so places hold only in this one."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def slices(table: pa.Table | pa.RecordBatch, column: str = "text", size: int = 1 << 20):
    """Row ranges of ``table`` whose texts have about ``size`` bytes each."""
    lengths = pc.fill_null(pc.binary_length(table.column(column)), 0)
    sums = np.cumsum(np.asarray(lengths.combine_chunks() if isinstance(lengths, pa.ChunkedArray) else lengths).astype(np.int64))
    at = 0
    while at < table.num_rows:
        done = sums[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sums, done + size, "right")))
        yield table.slice(at, to - at)
        at = to


class Texts:
    """The documents of a shard, their UTF-8 bytes end to end."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").combine_chunks()
        self.known = np.asarray(ids.is_valid())
        self.ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        column = table.column("text").cast(pa.large_binary()).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2] if len(column) else None
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = raw[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.lengths = np.diff(self.offsets)

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def posts(shard: int, bits: int, keys: np.ndarray, parts: list[np.ndarray]) -> pa.Table:
    """Rows for ``keys`` (sorted uint64): a bucket for each value of the leading bits.

    ``parts`` are arrays parallel to ``keys``; a row's body has a slice of each.
    """
    buckets = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    cuts = np.flatnonzero(buckets[1:] != buckets[:-1]) + 1
    starts = np.concatenate(([0], cuts)) if len(keys) else np.zeros(0, np.int64)
    ends = np.concatenate((cuts, [len(keys)])) if len(keys) else starts
    return pa.table(
        [
            pa.array(buckets[starts].astype(np.int64)),
            pa.array(np.full(len(starts), shard, np.int64)),
            pa.array((ends - starts).astype(np.int64)),
            pa.array([b"".join(p[a:b].tobytes() for p in parts) for a, b in zip(starts, ends)], pa.binary()),
        ],
        schema=_POST,
    )


def unposted(table: pa.Table, kinds: list[type]) -> tuple[list[np.ndarray], np.ndarray]:
    """The parts of all rows, each laid end to end, and the number of values of each row."""
    counts = np.asarray(table.column("n").combine_chunks()).astype(np.int64)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for n, body in zip(counts, table.column("body").to_pylist()):
        at = 0
        for part, kind in zip(out, kinds):
            part.append(np.frombuffer(body, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(out, kinds)], counts


def answers(table: pa.Table, kind: int, bits: np.ndarray, counts: np.ndarray) -> pa.Table:
    """A reply for each post: the bits of its values."""
    ends = np.cumsum(counts)
    bodies = [np.packbits(bits[e - n : e]).tobytes() for n, e in zip(counts, ends)]
    return pa.table(
        [table.column("shard"), pa.array(np.full(len(counts), kind, np.int32)), table.column("bucket"), pa.array(counts), pa.array(bodies, pa.binary())],
        schema=_REPLY,
    )


def read_answers(replies: pa.Table, kind: int) -> np.ndarray:
    """A shard's bits of one kind, in the order of its sorted values."""
    rows = sorted(
        (b, n, body)
        for k, b, n, body in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "n", "body")))
        if k == kind
    )
    return np.concatenate([np.unpackbits(np.frombuffer(body, np.uint8), count=n) for _, n, body in rows]).astype(bool) if rows else np.zeros(0, bool)


def group_first(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by ``keys`` (the first counts most), starts of the groups, and each row's group."""
    order = np.lexsort(keys[::-1])
    fresh = np.ones(len(order), bool)
    if len(order):
        fresh[1:] = False
        for k in keys:
            s = k[order]
            fresh[1:] |= s[1:] != s[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return order, np.flatnonzero(fresh), group


def shared_by_shards(table: pa.Table) -> pa.Table:
    """Bucket side of a recurrence question: is the value posted by two shards, or seen in two documents of one?

    Body: low 32 bits of the value past the bucket number, then a byte that says
    whether the shard itself has it in two documents.
    """
    (values, twice), counts = unposted(table, [np.uint32, np.uint8])
    _, inverse, times = np.unique(values, return_inverse=True, return_counts=True)
    own = np.zeros(len(times), bool)
    np.logical_or.at(own, inverse, twice > 0)
    return answers(table, 1, ((times > 1) | own)[inverse], counts)


def recurrence(bits: int, values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, cut to the bucket number and 32 bits more, sorted; whether two owners have them."""
    v = values >> np.uint64(32 - bits)
    order, starts, _ = group_first([v])
    if not len(v):
        return v, np.zeros(0, np.uint8)
    o = owners[order]
    return v[order][starts], (np.maximum.reduceat(o, starts) > np.minimum.reduceat(o, starts)).astype(np.uint8)


def recurrence_posts(shard: int, bits: int, v: np.ndarray, twice: np.ndarray) -> pa.Table:
    """``v``: of ``recurrence``.  A false match (two values alike in these bits) only adds a candidate."""
    return posts(shard, bits, v << np.uint64(32 - bits), [(v & np.uint64(0xFFFFFFFF)).astype(np.uint32), twice])


def earliest_owner(table: pa.Table) -> pa.Table:
    """Bucket side of a precedence question: does another shard have the value in a document with a smaller id?

    Body: the hash (64 and 32 bits) and the shard's smallest document id with it.
    """
    (h1, h2, owner), counts = unposted(table, [np.uint64, np.uint32, np.int64])
    if not len(h1):
        return answers(table, 2, np.zeros(0, bool), counts)
    order, starts, group = group_first([h1, h2])
    least = np.minimum.reduceat(owner[order], starts)
    return answers(table, 2, least[group] < owner, counts)
