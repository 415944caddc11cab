"""Training-order materialisation of token ids.

Documents are dealt into buckets by a hash, ordered within them, encoded and cut
into sequences of a fixed number of ids.  Every sequence has a dense index (the
sequences of the buckets before, and its rank in its own); a keyed Feistel network
over the next power of four, walked until it falls below the number of sequences,
maps that index to its slot.  Slots are dealt by range into shards of a fixed
stride, so that any slot's bytes are found by arithmetic and a reader resumes at
any slot.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import encoding, shared
from sieveline.llm.rolling import mix

SEQUENCE, PAD, KEY, ROUNDS = 512, 49407, 20240601, 4
SLOTS_PER_SHARD = 1024
#: Rows of a bucket, and the most buckets; a driver's array has a number for each.
BUCKET_ROWS, MAX_BUCKETS = 512, 65_536
SEQUENCES = "bucket int, rank long, doc_id long, sequence int, n_ids int, body binary"
SHARDS = "shard long, first_slot long, n_slots long, stride int, ids binary, doc_ids binary, sequences binary, lengths binary"
RESULT = "slot long, shard long, byte_offset long, doc_id long, sequence int, n_ids int, ids_crc32 long"


def permute(index: np.ndarray, size: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0..size-1, applied to ``index``."""
    half = max(1, ((max(size - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    x = index.astype(np.uint64)
    out = x.copy()
    todo = np.arange(len(x))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(rounds):
            left, right = right, left ^ (mix(right, key * 31 + r) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(size)]  # walk on until the value is in the domain
    return out.astype(np.int64)


def dealt(docs: DataFrame) -> DataFrame:
    """(bucket, doc_id, text), each bucket whole in a partition and in order.

    The number of buckets follows the number of rows alone, and a row's bucket its
    id and text, so the order doesn't depend on how the table was read.
    """
    n = min(max(1, math.ceil(docs.count() / BUCKET_ROWS)), MAX_BUCKETS)
    mark = F.xxhash64("doc_id", "text")
    return docs.select(F.pmod(mark, F.lit(n)).cast("int").alias("bucket"), "doc_id", "text").repartition("bucket").sortWithinPartitions("bucket", "doc_id", F.xxhash64("text"))


def cut(docs: DataFrame, vocabulary: str, length: int) -> DataFrame:
    """Sequences of at most ``length`` ids (unsigned 16 bits) of ``dealt`` rows, with their rank in the bucket.

    A text without ids gives none.  An id beyond 16 bits raises.
    """

    def encode(tables):
        bucket, rank = None, 0  # of the rows so far
        for t in tables:
            buckets = np.asarray(t.column("bucket"))
            ids, texts = t.column("doc_id"), t.column("text").to_pylist()
            for at, some in encoding.batches(texts):
                values, sizes = encoding.encoder(vocabulary).flat(some)
                if len(values) and int(values.max()) > 0xFFFF:
                    raise ValueError("the vocabulary has ids beyond 16 bits")
                pieces = -(-sizes // length)  # sequences of each text
                owner = np.repeat(np.arange(len(sizes)), pieces)
                sequence = np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner]
                starts = (np.cumsum(sizes) - sizes)[owner] + sequence * length
                lengths = np.minimum(sizes[owner] - sequence * length, length)
                own = buckets[at : at + len(some)][owner]
                # ranks go on from batch to batch
                ranks = np.arange(len(own))
                if len(own):
                    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    ranks -= np.repeat(first, np.diff([*first, len(own)]))
                    if own[0] == bucket:
                        ranks[own == bucket] += rank
                    bucket, rank = own[-1], int(ranks[-1]) + 1
                    data = pa.py_buffer(values.astype("<u2").tobytes())
                    offsets = np.concatenate((starts * 2, [2 * len(values)])).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own.astype(np.int32)),
                            pa.array(ranks.astype(np.int64)),
                            ids.take(pa.array(at + owner)),
                            pa.array(sequence.astype(np.int32)),
                            pa.array(lengths.astype(np.int32)),
                            pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets.tobytes()), data]),
                        ],
                        ["bucket", "rank", "doc_id", "sequence", "n_ids", "body"],
                    )

    return docs.mapInArrow(encode, SEQUENCES)


def materialise(docs: DataFrame, vocabulary: str, path: str, length: int = SEQUENCE, key: int = KEY, slots: int = SLOTS_PER_SHARD, pad: int = PAD) -> int:
    """Write the shards of all sequences in training order to ``path``; returns the number of sequences.

    One key and one corpus give one order, however the table is partitioned: the
    index that the key permutes counts sequences by bucket, doc_id and text.  Null
    and empty texts have no sequence; a null doc_id is carried as -1; equal rows
    are separate sequences; an empty table gives no shard.  The vocabulary must
    have at most 65,536 ids.  Only doc_id and text are read.
    """
    kept = shared.written(cut(dealt(docs), vocabulary, length), "sequences")
    # at most ``MAX_BUCKETS`` rows
    counts = dict((r.bucket, r.n) for r in kept.groupBy("bucket").agg(F.count("*").alias("n")).collect())
    sizes = np.zeros(max(counts, default=0) + 1, np.int64)
    for bucket, n in counts.items():
        sizes[bucket] = n
    total = int(sizes.sum())
    base = np.cumsum(sizes) - sizes
    spark = docs.sparkSession

    @F.pandas_udf("long")
    def slot_of(bucket: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series(permute(base[bucket.to_numpy()] + rank.to_numpy(), total, key))

    placed = kept.withColumn("slot", slot_of("bucket", "rank")).select(F.floor(F.col("slot") / slots).alias("shard"), "slot", "doc_id", "sequence", "n_ids", "body")

    def build(k, t):
        t = t.sort_by("slot").combine_chunks()
        n = t.num_rows
        ids = np.full((n, length), pad, "<u2")
        bodies = t.column("body").chunk(0) if n else pa.array([], pa.binary())
        cuts = np.frombuffer(bodies.buffers()[1], np.int32, n + 1, bodies.offset * 4) if n else np.zeros(1, np.int32)
        taken = np.frombuffer(bodies.buffers()[2], "<u2", (cuts[-1] - cuts[0]) // 2, cuts[0]) if cuts[-1] > cuts[0] else np.zeros(0, "<u2")
        # row by row, as many places from the left as the sequence has ids
        ids[np.arange(length) < (np.diff(cuts) // 2)[:, None]] = taken
        number = k[0].as_py()
        array = lambda c, kind: np.asarray(t.column(c).combine_chunks().fill_null(-1)).astype(kind).tobytes()
        return pa.table(
            [[number], [number * slots], [n], pa.array([2 * length], pa.int32()), [ids.tobytes()], [array("doc_id", "<i8")], [array("sequence", "<i4")], [array("n_ids", "<i4")]],
            names=["shard", "first_slot", "n_slots", "stride", "ids", "doc_ids", "sequences", "lengths"],
        )

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards_ = placed.repartitionByRange(parts, "shard").groupBy("shard").applyInArrow(build, SHARDS)
    # rows are large: look at their size often, and keep row groups small
    writer = shards_.write.option("compression", "zstd").option("parquet.page.size.row.check.min", 4).option("parquet.block.size", 32 << 20)
    writer.parquet(path)
    return total


def read(table: DataFrame, from_slot: int = 0) -> DataFrame:
    """One row per slot from ``from_slot`` on, read from the shards' bytes; shards before it are not read."""

    def rows(tables):
        for t in tables:
            for s in t.to_pylist():
                n, stride = s["n_slots"], s["stride"]
                skip = max(0, from_slot - s["first_slot"])
                lengths = np.frombuffer(s["lengths"], "<i4")
                crcs = [zlib.crc32(s["ids"][i * stride : i * stride + 2 * int(lengths[i])]) for i in range(skip, n)]
                at = np.arange(skip, n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at + s["first_slot"]), pa.array(np.full(len(at), s["shard"], np.int64)), pa.array(at * stride), pa.array(np.frombuffer(s["doc_ids"], "<i8")[skip:]), pa.array(np.frombuffer(s["sequences"], "<i4")[skip:]), pa.array(lengths[skip:]), pa.array(crcs, pa.int64())],
                    ["slot", "shard", "byte_offset", "doc_id", "sequence", "n_ids", "ids_crc32"],
                )

    return table.where(F.col("first_slot") + F.col("n_slots") > from_slot).mapInArrow(rows, RESULT)


def round_trip(docs: DataFrame, vocabulary: str, **settings) -> DataFrame:
    """Materialise into the shared folder and read every slot back."""
    spark = docs.sparkSession
    path = shared.new_path(spark, "training-order")
    materialise(docs, vocabulary, path, **settings)
    return read(spark.read.schema(SHARDS).parquet(path))
