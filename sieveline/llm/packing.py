"""Pattern packing of documents into sequences.

Lengths are few (1 to the capacity), so the plan is made on their histogram: fit
repeat counts of few-document patterns to it by non-negative least squares, round
them down, and pack what remains best-fit decreasing.  Only the histogram reaches
the driver (as many rows as the capacity at most); pieces find their place from
their rank among equal lengths.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm import encoding, shared

CAPACITY = 2048
GROUP_ROWS = 40_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RESULT = f"{PIECES}, sequence_id long, offset long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces only beyond ``capacity``."""

    def cut(tables):
        for table in tables:
            ids, texts = table.column("doc_id"), table.column("text").to_pylist()
            for at, some in encoding.batches(texts):
                values, sizes = encoding.encoder(vocabulary).flat(some)
                body = memoryview(np.insert(values, np.cumsum(sizes), end_id).astype("<u4")).cast("B")
                sizes = sizes + 1
                pieces = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner]
                begins = 4 * ((np.cumsum(sizes) - sizes)[owner] + piece * capacity)
                lengths = np.minimum(sizes[owner] - piece * capacity, capacity)
                sums = [zlib.crc32(body[a : a + n]) for a, n in zip(begins.tolist(), (4 * lengths).tolist())]
                columns = [ids.take(pa.array(at + owner)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(lengths), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def _patterns(histogram: np.ndarray, capacity: int, wide: int = 12) -> np.ndarray:
    """Rows of up to four lengths (0: none) that fill ``capacity`` as well as the lengths at hand allow."""
    present = np.flatnonzero(histogram)
    below = np.zeros(capacity + 1, np.int64)  # the largest present length up to each value
    below[present] = present
    below = np.maximum.accumulate(below)
    found = set()
    common = present[np.argsort(-histogram[present], kind="stable")]
    for a in present.tolist():
        b = int(below[capacity - a])
        found.add((max(a, b), min(a, b), 0, 0))
        rest = capacity - a
        seconds = {int(below[rest]), int(below[rest // 2]), int(below[rest // 3]), int(below[min(rest, a)])}
        seconds |= {int(c) for c in common[:wide] if c <= rest}
        seconds |= {int(below[rest * k // wide]) for k in range(1, wide)}
        for b in seconds - {0}:
            c = int(below[rest - b])
            found.add(tuple(sorted((a, b, c, 0), reverse=True)))
            for c in {int(below[(rest - b) // 2]), int(below[(rest - b) * 3 // 4])} - {0}:
                found.add(tuple(sorted((a, b, c, int(below[rest - b - c])), reverse=True)))
    rows = np.array(sorted(found, reverse=True), np.int64).reshape(-1, 4)
    full = rows.sum(1)
    return rows[full >= 0.999 * capacity]


def _fit(rows: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeat counts whose lengths come nearest the histogram (projected gradient with momentum)."""
    weight = (rows > 0).astype(float)
    size = len(histogram)

    def lengths(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows.ravel(), (weight * x[:, None]).ravel(), size)

    # a bound of the largest eigenvalue of A'A by power iteration
    v = np.ones(len(rows))
    for _ in range(20):
        u = (weight * lengths(v)[rows]).sum(1)
        step = np.linalg.norm(u) / max(np.linalg.norm(v), 1e-30)
        v = u / max(np.linalg.norm(u), 1e-30)
    x = y = np.zeros(len(rows))
    t = 1.0
    target = histogram.astype(float)
    target[0] = 0
    for _ in range(rounds):
        gradient = (weight * (lengths(y) - target)[rows]).sum(1)
        new = np.maximum(y - gradient / max(1.05 * step, 1e-9), 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths) with their repeat counts, using each length as often as the histogram has it.

    ``histogram[n]`` counts the pieces of length n.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    rows = _patterns(left, capacity) if left.any() else np.zeros((0, 4), np.int64)
    if len(rows):
        counts = np.floor(_fit(rows, left) + 1e-6).astype(np.int64)
        for k in np.argsort(-rows.sum(1) * 10_000_000 - counts, kind="stable").tolist():
            if counts[k]:
                own = [int(n) for n in rows[k] if n]
                times = min(int(left[n]) // own.count(n) for n in own)
                times = min(times, int(counts[k]))
                if times:
                    for n in own:
                        left[n] -= times
                    out.append((tuple(own), times))
    # the rest, best-fit decreasing; bins of the same room are handled together
    room: dict[int, list[list]] = {}
    for n in range(capacity, 0, -1):
        todo = int(left[n])
        while todo:
            fits = [r for r in room if r >= n]
            if fits:
                r = min(fits)
                filled, times = room[r][-1]
                k = min(todo, times)
                room[r][-1][1] -= k
                if not room[r][-1][1]:
                    room[r].pop()
                    if not room[r]:
                        del room[r]
                room.setdefault(r - n, []).append([(*filled, n), k])
                todo -= k
            else:
                each = capacity // n
                k, rest = divmod(todo, each)
                if k:
                    room.setdefault(capacity - each * n, []).append([(n,) * each, k])
                if rest:
                    room.setdefault(capacity - rest * n, []).append([(n,) * rest, 1])
                todo = 0
    out += [(filled, times) for bins in room.values() for filled, times in bins]
    return out


def _places(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: ranks at which its intervals begin, their first sequence, their offset."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for own, times in patterns:
        offset = 0
        for n in own:
            found.setdefault(n, []).append((times, base, offset))
            offset += n
        base += times
    out = {}
    for n, rows in found.items():
        times, first, offset = (np.array(c, np.int64) for c in zip(*rows))
        out[n] = (np.cumsum(times) - times, first, offset)
    return out


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Place every piece of every document in a sequence of at most ``capacity`` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and
    offset; each sequence is gapless from 0.  Null and empty texts are the end id
    alone; equal rows are packed as separate documents; an empty table gives no
    row.  Only doc_id and text are read, whatever other columns are called.
    """
    kept = shared.written(pieces(docs, vocabulary, capacity, end_id), "pieces")
    counts = kept.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for n, c in counts:
        histogram[n] = c
    places = _places(plan(histogram, capacity), capacity)
    groups = max(1, math.ceil(int(histogram.sum()) / group_rows))
    dealt = kept.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        dealt.groupBy("length", "deal")
        .agg(F.count("*").alias("n"))
        # the other side of the cogroup has a column ``length`` of its own, which must not be this one
        .select(F.col("deal").alias("rank_deal"), F.col("length").alias("rank_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    )

    def place(own, firsts):
        first = dict(zip(firsts.column("rank_length").to_pylist(), firsts.column("first_rank").to_pylist()))
        own = own.drop_columns(["deal"]).sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = np.asarray(own.column("length").combine_chunks())
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        starts = np.flatnonzero(np.concatenate(([True], lengths[1:] != lengths[:-1]))) if len(lengths) else np.zeros(0, np.int64)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(lengths)]):
            n = int(lengths[a])
            ranks = first[n] + np.arange(b - a)
            begins, base, at = places[n]
            k = np.searchsorted(begins, ranks, side="right") - 1
            sequence[a:b] = base[k] + ranks - begins[k]
            offset[a:b] = at[k]
        return own.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("deal").cogroup(ranks.groupBy("rank_deal")).applyInArrow(place, RESULT)
