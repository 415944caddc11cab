"""Byte-level substring dedup by merging Burrows-Wheeler transforms.

1. Every window of ``WINDOW`` bytes has a least 16-byte gram (by hash).  Grams that
   two documents share are found first; runs of windows with such a gram are the
   segments that may recur.
2. Segments with the same gram meet in one bucket; a gram that stands in very many
   places is split by the second least gram of its windows first.  Equal segments collapse to
   one with the smallest document id, and each is trimmed to what it can share
   with another around the gram, left and right.
3. A bucket's segments form shards; each shard's suffixes are sorted once, which
   gives its Burrows-Wheeler transform.  The transforms of all shards are merged by
   refining their interleave, a letter a round: rows that still agree after the
   rounds of a window are one interval of suffixes with that common prefix, and
   the interval's smallest document id decides.  No suffix is sorted again.

A letter is ``STEP`` bytes, so a suffix is read in strides of STEP and a window
takes WINDOW / STEP rounds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sieveline.llm import rolling, shards

WINDOW, STEP, GRAM = 50, 5, 16
SHARD_BYTES = 4 << 20
#: Windows of a segment, rows of a shard's transform and rows merged at once (a gram's segments stay together).
LONGEST, TRANSFORM_ROWS, MERGE_ROWS = 64, 8_000, 60_000
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"
#: Places from which on a gram's segments are split by their second least gram: so many take about 300 MB in one task.
HOT = 65_536
_BLOCK = 1 << 16
_U = np.uint64


def _eights(data: np.ndarray) -> np.ndarray:
    """The 64-bit value at each byte (unaligned)."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), 0, (1,))


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes at each place."""
    eight = _eights(data)
    if len(eight) <= 8:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return rolling.mix(eight[:-8] * _U(0x9FB21C651E98DF25) + rolling.mix(eight[8:], 1))


def minima(data: np.ndarray) -> np.ndarray:
    """Least gram of each window, computed in blocks that fit the cache."""
    n = max(0, len(data) - WINDOW + 1)
    out = np.empty(n, np.uint64)
    for a in range(0, n, _BLOCK):
        b = min(a + _BLOCK, n)
        out[a:b] = rolling.sliding(grams(data[a : b + WINDOW - 1]), WINDOW - GRAM + 1, np.minimum)
    return out


def second_minima(data: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of the windows at ``starts`` the least gram that isn't their least one, ``first`` (all ones if there is none)."""
    out = np.empty(len(starts), np.uint64)
    own, span = grams(data), np.arange(WINDOW - GRAM + 1)
    for a in range(0, len(starts), _BLOCK):
        here = own[starts[a : a + _BLOCK, None] + span]
        here[here == first[a : a + _BLOCK, None]] = _U(2**64 - 1)
        out[a : a + _BLOCK] = here.min(1)
    return out


class _Shard:
    def __init__(self, table: pa.Table):
        self.texts = texts = shards.Texts(table)
        self.minima = minima(texts.data)
        valid = np.ones(len(self.minima), bool)
        ends = texts.offsets[1:]
        late = (ends[:, None] - np.arange(1, WINDOW)).ravel()
        owner = np.repeat(texts.offsets[:-1], WINDOW - 1)
        late = late[(late >= owner) & (late < len(valid))]
        valid[late] = False
        for i in np.flatnonzero(~texts.known):
            valid[texts.offsets[i] : texts.offsets[i + 1]] = False
        # minima are small numbers; mixed, they spread over the buckets
        self.set_runs(*rolling.runs(self.minima, valid))
        self.values = rolling.mix(self.minima[self.starts], 9)

    def set_runs(self, starts: np.ndarray, stops: np.ndarray) -> None:
        """Segments of these runs of windows; long runs (periodic text) are cut."""
        pieces = -(-(stops - starts) // LONGEST)
        self.starts = np.repeat(starts, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LONGEST
        self.stops = np.minimum(self.starts + LONGEST, np.repeat(stops, pieces))
        self.ids = self.texts.ids[np.searchsorted(self.texts.offsets[1:], self.starts, "right")]

    def anchors(self, bits: int):
        """Distinct grams, and for each how often the shard has it (127 at most), plus 128 if two documents have it."""
        v, twice = shards.recurrence(bits, self.values, self.ids)
        times = np.bincount(np.searchsorted(v, self.values >> _U(32 - bits)), minlength=len(v))
        return v, (np.minimum(times, 127) + 128 * twice.astype(np.int64)).astype(np.uint8)

    def split(self, bits: int, hot: np.ndarray) -> None:
        """Segments of grams in ``hot`` are cut into runs of windows with one second least gram, and named by both."""
        of = rolling.mix(self.minima, 9)
        is_hot = np.isin(of >> _U(32 - bits), hot)
        valid = np.zeros(len(self.minima), bool)
        index, _ = gather(np.arange(len(valid)), self.starts, self.stops - self.starts)
        valid[index] = True
        name, at = of.copy(), np.flatnonzero(is_hot & valid)
        name[at] = rolling.mix(of[at] ^ rolling.mix(second_minima(self.texts.data, at, self.minima[at]), 15), 16)
        starts, stops = rolling.runs(name, valid)
        # where a run ends with its document, the next one's first window is another segment
        self.set_runs(starts, stops)
        self.values, self.asked = name[self.starts], of[self.starts]

    def segments(self, bits: int, replies: pa.Table):
        """Distinct segments with recurring grams, sorted by gram: one place of each and its smallest document; of all places, the segment."""
        v, _ = self.anchors(bits)
        recurs, hot = (read_flags(replies, kind, len(v)) for kind in (1, 3))
        if hot.any():
            self.split(bits, v[hot])
        # a split segment's gram was asked about before it was split
        recurring = v[recurs]
        cut = self.asked >> _U(32 - bits) if hot.any() else self.values >> _U(32 - bits)
        at = np.minimum(np.searchsorted(recurring, cut), max(len(recurring) - 1, 0))
        self.chosen = np.flatnonzero(recurring[at] == cut) if len(recurring) else np.zeros(0, np.int64)
        starts, lengths = self.starts[self.chosen], self.stops[self.chosen] - self.starts[self.chosen] + WINDOW - 1
        text, _ = gather(self.texts.data, starts, lengths)
        h1, h2 = content(text, lengths)
        order, first, group = shards.group_first([self.values[self.chosen], h1, h2])
        ids = self.ids[self.chosen]
        least = np.minimum.reduceat(ids[order], first) if len(first) else ids
        one = order[first]
        return starts[one], lengths[one], self.values[self.chosen][one], least, group, ids


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of ``data`` laid end to end, and where each begins."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - begins, lengths)
    return data[index], begins


def content(text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each range of a text of ranges."""
    ends = np.cumsum(lengths)
    out = []
    for base in rolling.BASES:
        with np.errstate(over="ignore"):
            prefix = rolling.Prefix(text.astype(np.uint64) + _U(1), base)
            raw = (prefix.sums[ends] - prefix.sums[ends - lengths]) * prefix.inverse[ends - lengths]
            out.append(rolling.mix(raw + lengths.astype(np.uint64)))
    return out[0], out[1]


def recurs_or_hot(table: pa.Table, hot: int) -> pa.Table:
    """Bucket side: do two documents have the gram (kind 1)?  Do all shards together have it ``hot`` times or more (kind 3)?"""
    (values, told), counts = shards.unposted(table, [np.uint32, np.uint8])
    _, inverse, shards_ = np.unique(values, return_inverse=True, return_counts=True)
    own = np.zeros(len(shards_), bool)
    np.logical_or.at(own, inverse, told >= 128)
    times = np.bincount(inverse, told & 127, len(shards_))
    out = [shards.answers(table, 1, ((shards_ > 1) | own)[inverse], counts)]
    often = (times >= hot)[inverse]
    if often.any():
        out.append(shards.answers(table, 3, often, counts))
    return pa.concat_tables(out)


def read_flags(replies: pa.Table, kind: int, n: int) -> np.ndarray:
    """A shard's bits of one kind; buckets that sent none have zeros."""
    told = {b: np.unpackbits(np.frombuffer(body, np.uint8), count=m) for k, b, m, body in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "n", "body"))) if k == kind}
    sizes = sorted((b, m) for k, b, m in zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "n"))) if k == 1)
    parts = [told.get(b, np.zeros(m, np.uint8)) for b, m in sizes]
    out = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
    return out if len(out) == n else np.zeros(n, bool)


def _segment_posts(shard: int, bits: int, s: _Shard, found) -> pa.Table:
    starts, lengths, values, least, _, _ = found
    buckets = (values >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    rows = []
    for part in np.split(np.arange(len(values)), cuts) if len(values) else []:
        text, _ = gather(s.texts.data, starts[part], lengths[part])
        body = values[part].tobytes() + lengths[part].astype(np.uint16).tobytes() + least[part].tobytes() + text.tobytes()
        rows.append((int(buckets[part[0]]), shard, len(part), body))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "shard", "n", "body"])


def _shared_extent(group: np.ndarray, sides: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each row (padded bytes) how far it can agree with another row of its group; at most its length."""
    n, width = sides.shape
    columns = np.ascontiguousarray(sides).view(">u8").reshape(n, -1)
    order = np.lexsort([*columns.T[::-1], group])
    differ = sides[order[1:]] != sides[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), width)
    common[group[order[1:]] != group[order[:-1]]] = 0
    reach = np.zeros(n, np.int64)
    np.maximum.at(reach, order[1:], common)
    np.maximum.at(reach, order[:-1], common)
    return np.minimum(reach, lengths)


def trim(values: np.ndarray, text: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of each segment (relative) that can be shared around its gram with another segment of that gram."""
    n = len(values)
    owner = np.repeat(np.arange(n), lengths)
    here = rolling.mix(grams(text), 9)
    same = np.flatnonzero(here == values[owner[: len(here)]])
    same = same[same + GRAM <= (begins + lengths)[owner[same]]]
    times = np.bincount(owner[same], minlength=n)
    place = np.zeros(n, np.int64)
    place[owner[same][::-1]] = same[::-1] - begins[owner[same][::-1]]
    _, group = np.unique(values, return_inverse=True)
    # a gram that a segment has twice fixes no alignment: its group stays whole
    whole = np.bincount(group, times != 1)[group] > 0
    width = -(-int(lengths.max()) // 8) * 8
    padded = np.zeros((n, width), np.uint8)
    right = lengths - place
    padded[owner, np.arange(len(text)) - (begins + place)[owner]] = text  # the left part lands at the row's end
    tail = np.arange(width)[None, :] >= right[:, None]
    ahead = np.where(tail, 0, padded)
    reach_right = _shared_extent(group, ahead, right)
    back = np.zeros((n, width), np.uint8)
    left_of = np.arange(len(text)) - begins[owner] < place[owner]
    back[owner[left_of], (place[owner] - 1 - (np.arange(len(text)) - begins[owner]))[left_of]] = text[left_of]
    reach_left = _shared_extent(group, back, place)
    return np.where(whole, 0, place - reach_left), np.where(whole, lengths, place + reach_right)


def transform(rank: np.ndarray, follower: np.ndarray) -> np.ndarray:
    """Order of a shard's suffixes, by prefix doubling; ``rank`` is 0 past the last letter, ``follower`` the place a letter on."""
    n = len(rank)
    _, rank = np.unique(rank, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    while True:
        after = np.where(follower < n, rank[np.minimum(follower, n - 1)] + 1, 0)
        small = np.uint16 if n < 65_000 else np.int64
        order = np.argsort(after.astype(small), kind="stable")
        order = order[np.argsort(rank[order].astype(small), kind="stable")]
        new = np.zeros(n, np.int64)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(new)
        if fresh.max() == rank.max():  # nothing is told apart any more
            return order
        rank = fresh
        follower = np.where(follower < n, follower[np.minimum(follower, n - 1)], n)


def merge(text: np.ndarray, begins: np.ndarray, lengths: np.ndarray, owners: np.ndarray, window: int = WINDOW, step: int = STEP, transform_rows: int = TRANSFORM_ROWS) -> np.ndarray:
    """For each place of each segment (``lengths`` + 1 of them) the smallest owner of its window; a large number where no window fits."""
    n = len(lengths)
    rows = lengths + 1
    ends = np.cumsum(rows)
    base = ends - rows
    segment = np.repeat(np.arange(n), rows)
    at = np.arange(ends[-1]) - base[segment]
    lettered = at + step <= lengths[segment]
    source = np.minimum((begins - base)[segment] + np.arange(ends[-1]), max(len(text) - 1, 0))
    letter = np.zeros(ends[-1], np.uint64)
    padded = np.concatenate((text, np.zeros(step, np.uint8)))
    for j in range(step):
        letter = (letter << _U(8)) | padded[source + j]
    _, name = np.unique(np.where(lettered, letter + _U(1), _U(0)), return_inverse=True)
    if lettered.all():
        name += 1
    name[~lettered] = 0
    # each shard's transform: its rows in order, and the letter before each
    cuts = np.flatnonzero(np.diff(base // transform_rows)) + 1
    shard_rows = [(base[g[0]], ends[g[-1]]) for g in np.split(np.arange(n), cuts)]
    row = np.empty(ends[-1], np.int64)
    for a, b in shard_rows:
        follower = np.where(lettered[a:b], np.arange(b - a) + step, b - a)
        row[a:b] = a + transform(name[a:b], follower)
    small = np.uint16 if len(shard_rows) < 65_000 and name.max() < 65_000 else np.int64
    interleave = np.repeat(np.arange(len(shard_rows)), [b - a for a, b in shard_rows]).astype(small)
    preceded = at[row] >= step
    before = np.where(preceded, name[row - np.where(preceded, step, 0)], 0).astype(small)
    bare = interleave[name[row] == 0]  # rows without a letter stand first, shard after shard
    block = np.zeros(ends[-1], np.int64)
    place = np.argsort(interleave, kind="stable")
    for _ in range(window // step):
        written, has = np.empty_like(before), np.empty(len(before), bool)
        written[place], has[place] = before, preceded
        letters, shard_of, block_of = written[has], interleave[has], block[has]
        order = np.argsort(letters, kind="stable")
        letters, block_of = letters[order], block_of[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (letters[1:] != letters[:-1]) | (block_of[1:] != block_of[:-1])
        interleave = np.concatenate((bare, shard_of[order]))
        block = np.concatenate((np.zeros(len(bare), np.int64), np.cumsum(fresh)))
        place = np.argsort(interleave, kind="stable")
    # rows of one block share the window; place tells where each shard's rows stand
    out = np.full(ends[-1], np.iinfo(np.int64).max)
    of = np.empty(ends[-1], np.int64)
    of[row] = block[place]
    fits = at + window <= lengths[segment]
    least = np.full(int(block.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, of[fits], owners[segment][fits])
    out[fits] = least[of[fits]]
    return out


def decide(table: pa.Table) -> pa.Table:
    """Bucket side: for each window of each posted segment, does it stand in a document with a smaller id?"""
    counts, values, lengths, owners, texts = [], [], [], [], []
    for n, body in zip(table.column("n").to_pylist(), table.column("body").to_pylist()):
        values.append(np.frombuffer(body, np.uint64, n))
        lengths.append(np.frombuffer(body, np.uint16, n, 8 * n).astype(np.int64))
        owners.append(np.frombuffer(body, np.int64, n, 10 * n))
        texts.append(np.frombuffer(body, np.uint8, -1, 18 * n))
        counts.append(int((lengths[-1] - WINDOW + 1).sum()))
    value, length, owner, text = (np.concatenate(x) for x in (values, lengths, owners, texts))
    begin = np.cumsum(length) - length
    # equal segments are one, with their smallest owner
    order, first, group = shards.group_first([value, *content(text, length)])
    one = order[first]
    least = np.minimum.reduceat(owner[order], first)
    u_value, u_length = value[one], length[one]
    u_text, u_begin = gather(text, begin[one], u_length)
    low, high = trim(u_value, u_text, u_begin, u_length)
    fit = np.flatnonzero(high - low >= WINDOW)
    # what is left of them, again once each
    t_length = (high - low)[fit]
    t_text, t_begin = gather(u_text, u_begin[fit] + low[fit], t_length)
    t_order, t_first, t_group = shards.group_first([u_value[fit], *content(t_text, t_length)])
    t_one = t_order[t_first]
    t_least = np.minimum.reduceat(least[fit][t_order], t_first) if len(t_first) else least[:0]
    # whole grams, up to so many rows at a time
    m_length, m_begin, m_value = t_length[t_one], t_begin[t_one], u_value[fit][t_one]
    decided = np.zeros(int((m_length + 1).sum()), np.int64)
    m_base = np.cumsum(m_length + 1) - (m_length + 1)
    a, n = 0, len(t_one)
    edges = np.flatnonzero(np.concatenate((m_value[1:] != m_value[:-1], [True]))) + 1 if n else np.zeros(0, np.int64)
    while a < n:
        k = np.searchsorted(m_base, m_base[a] + MERGE_ROWS)
        later = edges[edges > a]
        b = int(later[later <= k][-1]) if (later <= k).any() else int(later[0])
        part, part_begin = gather(t_text, m_begin[a:b], m_length[a:b])
        out = merge(part, part_begin, m_length[a:b], t_least[a:b])
        decided[m_base[a] : m_base[a] + len(out)] = out
        a = b
    # smallest owner of each window of each distinct segment
    windows = u_length - WINDOW + 1
    w_end = np.cumsum(windows)
    smallest = np.repeat(least, windows)
    inner = t_length - WINDOW + 1
    into, _ = gather(np.arange(w_end[-1]), (w_end - windows)[fit] + low[fit], inner)
    out_of, _ = gather(decided, m_base[t_group], inner)
    smallest[into] = np.minimum(smallest[into], out_of)
    # and of each posted one
    posted = length - WINDOW + 1
    all_smallest, _ = gather(smallest, (w_end - windows)[group], posted)
    bits = all_smallest < np.repeat(owner, posted)
    return shards.answers(table, 2, bits, np.array(counts, np.int64))


def dedup(docs: DataFrame, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """Remove each byte covered by a 50-byte string that also starts in a document with a smaller id.

    One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 and kept_text (bytes: a cut may split a character).  Null and
    empty texts have no bytes.  Rows with a null doc_id are kept whole and remove
    nothing; rows that share a doc_id do not affect each other; an empty table gives
    no row; extra columns are not read, whatever their names.
    """
    n, bits = shards.plan_shards(docs, "text", shard_bytes)
    by_shard = shards.deal(docs, n).groupBy("shard")

    def ask(key, table):
        return shards.recurrence_posts(key[0].as_py(), bits, *_Shard(table).anchors(bits))

    def post(key, table, replies):
        s = _Shard(table)
        return _segment_posts(key[0].as_py(), bits, s, s.segments(bits, replies))

    def remove(key, table, replies):
        s = _Shard(table)
        _, lengths, _, least, group, ids = s.segments(bits, replies)
        windows = lengths - WINDOW + 1
        answered = shards.read_answers(replies, 2)
        sizes = windows[group]
        gone, _ = gather(answered, (np.cumsum(windows) - windows)[group], sizes)
        gone = gone | np.repeat(ids > least[group], sizes)
        starts, _ = gather(np.arange(len(s.minima)), s.starts[s.chosen], sizes)
        dropped = rolling.cover(starts[gone], WINDOW, len(s.texts.data))
        rows = []
        for a, b in zip(s.texts.offsets[:-1].tolist(), s.texts.offsets[1:].tolist()):
            out = dropped[a:b]
            kept = s.texts.data[a:b][~out].tobytes()
            spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
            rows.append((b - a, b - a - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table([table.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    first = by_shard.applyInArrow(ask, shards.POST).groupBy("bucket").applyInArrow(lambda table: recurs_or_hot(table, hot), shards.REPLY)
    second = by_shard.cogroup(first.groupBy("shard")).applyInArrow(post, shards.POST).groupBy("bucket").applyInArrow(decide, shards.REPLY)
    return by_shard.cogroup(first.unionByName(second).groupBy("shard")).applyInArrow(remove, RESULT)
