"""Substring dedup of word windows with sharded phrase automata.

1. Confirm: every window of ``window`` words has a least ``phrase``-word gram
   (by hash); a gram that two documents share makes a recurring phrase.
2. Compile: each shard of the phrases, those that its documents have as the least
   of some window, becomes one Aho-Corasick automaton, compiled once.
3. Stream: all documents run through the automaton of their shard once; its hits
   alone are the occurrences.  Each marks the windows around it, which are written
   down, and only those windows are compared by a 96-bit hash with all others, to
   find the smallest document id that has them.
4. Remove: a last pass reads the windows and the answers; it hashes nothing again.

A window that recurs holds its least gram wherever it stands, so no recurring
window is missed; the comparison decides, so nothing else is removed.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import rolling, shards, shared

WINDOW, PHRASE, SHARD_BYTES = 50, 8, 4 << 20
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
RESULT_COLUMNS = tuple(c.split()[0] for c in RESULT.split(", "))

_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_LONG_WORD = 64


def word_bounds(texts: shards.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word (maximal run without ASCII white space), and the number of words of each text."""
    inside = _INSIDE[texts.data]
    begins, lasts = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    lasts[:-1] &= ~inside[1:]
    some = texts.lengths > 0
    first, last = texts.offsets[:-1][some], texts.offsets[1:][some] - 1
    begins[first], lasts[last] = inside[first], inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(lasts) + 1, np.diff(np.searchsorted(starts, texts.offsets))


def words(texts: shards.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words of each text."""
    starts, ends, counts = word_bounds(texts)
    data = np.zeros(len(texts.data) + 8, np.uint8)
    data[:-8] = texts.data
    eight = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))
    lengths = ends - starts
    hashes = rolling.mix((eight[starts] & _MASK[np.minimum(lengths, 8)]) + rolling.mix(lengths.astype(np.uint64), 6), 7)
    # eight bytes at a time; the few words beyond by themselves
    for k in range(8, _LONG_WORD, 8):
        more = np.flatnonzero((lengths > k) & (lengths <= _LONG_WORD))
        if len(more):
            hashes[more] = rolling.mix(hashes[more] ^ (eight[starts[more] + k] & _MASK[np.minimum(lengths[more] - k, 8)]), 7)
    for i in np.flatnonzero(lengths > _LONG_WORD).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(texts.data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes, counts


class _Shard:
    """Windows of a shard's documents."""

    def __init__(self, table: pa.Table, window: int, phrase: int):
        self.texts = shards.Texts(table)
        self.hashes, self.counts = words(self.texts)
        self.prefix = rolling.Prefix(self.hashes)
        self.minima = rolling.window_minima(self.prefix, phrase, window)
        self.valid = (rolling.valid_starts(self.counts, window) & np.repeat(self.texts.known, self.counts))[: len(self.minima)]
        self.ids = np.repeat(self.texts.ids, self.counts)
        self.window, self.phrase = window, phrase

    def anchors(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the least phrases of all windows: their hashes and whether two documents of the shard have them."""
        starts, _ = rolling.runs(self.minima, self.valid)
        # minima are small numbers; mixed, they spread over the buckets
        return shards.recurrence(bits, rolling.mix(self.minima[starts], 9), self.ids[starts])

    def phrases(self, bits: int, recurring: np.ndarray) -> np.ndarray:
        """A place of each confirmed phrase: one of the ``recurring`` hashes."""
        starts, _ = rolling.runs(self.minima, self.valid)
        value, once = np.unique(self.minima[starts], return_index=True)
        cut = rolling.mix(value, 9) >> np.uint64(32 - bits)
        at = np.searchsorted(recurring, cut)
        confirmed = recurring[np.minimum(at, len(recurring) - 1)] == cut if len(recurring) else np.zeros(len(cut), bool)
        starts = starts[once[confirmed]]
        grams = self.prefix.every(self.phrase)
        return starts + np.argmin(grams[starts[:, None] + np.arange(self.window - self.phrase + 1)], 1) if len(starts) else starts

    def occurrences(self, phrases: np.ndarray) -> np.ndarray:
        """Places of all occurrences of the phrases, as their automaton finds them in the shard's documents."""
        if not len(phrases):
            return phrases
        patterns = phrases[:, None] + np.arange(self.phrase)
        # a letter for each word of the phrases; code 0 for all others
        alphabet = np.unique(self.hashes[patterns])
        rank = np.minimum(np.searchsorted(alphabet, self.hashes), len(alphabet) - 1)
        letters = np.where(alphabet[rank] == self.hashes, rank % 1_000_000 + 1, 0).astype("<u4")
        letters[letters >= 0xD800] += 0x800  # past the surrogates
        spelled = letters.tobytes().decode("utf-32-le")
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in phrases.tolist():
            automaton.add_word(spelled[p : p + self.phrase])
        automaton.make_automaton()
        ends = np.cumsum(self.counts)
        begins = ends - self.counts
        long = self.counts >= self.window
        found = [np.fromiter((e for e, _ in automaton.iter(spelled, a, b)), np.int64) for a, b in zip(begins[long].tolist(), ends[long].tolist())]
        return np.concatenate(found) - self.phrase + 1 if found else np.zeros(0, np.int64)

    def around(self, places: np.ndarray) -> np.ndarray:
        """Starts of the windows whose least phrase stands at one of ``places``: no other window can recur."""
        grams = self.prefix.every(self.phrase)
        found = np.full(len(grams), 2**64 - 1, np.uint64)
        found[places] = grams[places]
        least = rolling.sliding(found, self.window - self.phrase + 1, np.minimum)
        return np.flatnonzero((least == self.minima) & self.valid)

    def windows(self, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Distinct windows (their hashes, sorted, and smallest document), and for each start its window and document."""
        h1 = self.prefix.at(starts, self.window)
        h2 = (rolling.Prefix(self.hashes, rolling.BASES[1]).at(starts, self.window) >> np.uint64(32)).astype(np.uint32)
        ids = self.ids[starts]
        order, first, group = shards.group_first([h1, h2])
        least = np.minimum.reduceat(ids[order], first) if len(first) else ids
        return [h1[order][first], h2[order][first], least], group, ids


def dedup(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_bytes: int = SHARD_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove each word covered by a window that also starts in a document with a smaller id.

    One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words
    joined by one space), kept_text (the text itself where nothing is removed, else
    the kept words joined by one space), and the columns to ``keep`` as they are.
    Null and empty texts have no words.  Rows with a null doc_id are kept whole and
    remove nothing; rows that share a doc_id do not affect each other; an empty table
    gives no row.  Only doc_id, text and the columns to keep are read; a column of any
    other name than the result's can be kept.
    """
    n, bits = shards.plan_shards(docs, "text", shard_bytes)
    if clash := {c for c in keep if c in RESULT_COLUMNS}:
        raise ValueError(f"the result has columns of these names itself: {sorted(clash)}")
    names = [f"kept_column_{i}" for i in range(len(keep))]  # that clash with none of the columns within
    dealt = shards.deal(docs.withColumns({k: F.col(f"`{c}`") for k, c in zip(names, keep)}), n, tuple(names))
    result = ", ".join([RESULT, *(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(names, keep))])

    def ask(key, table):
        s = _Shard(table, window, phrase)
        return shards.recurrence_posts(key[0].as_py(), bits, *s.anchors(bits))

    def locate(key, table, replies):
        s = _Shard(shards.in_order(table), window, phrase)  # the last pass reads the places
        v, _ = s.anchors(bits)
        starts = s.around(s.occurrences(s.phrases(bits, v[shards.read_answers(replies, 1)])))
        (h1, h2, least), group, ids = s.windows(starts)
        asked = shards.posts(key[0].as_py(), bits, h1, [h1, h2, least])
        # for the last pass: the windows, what was asked about each, and whether the shard itself knows the answer
        own = b"".join((np.diff(starts, prepend=0).astype(np.int32).tobytes(), group.astype(np.int32).tobytes(), np.packbits(ids > least[group]).tobytes()))
        return pa.concat_tables([asked, pa.table([[-1], [key[0].as_py()], [len(starts)], pa.array([own], pa.binary())], schema=asked.schema)])

    def remove(key, table, replies):
        table = shards.in_order(table)
        texts = shards.Texts(table)
        _, _, counts = word_bounds(texts)
        dropped = np.zeros(int(counts.sum()), bool)
        for k, n, own in zip(*(replies.column(c).to_pylist() for c in ("kind", "n", "body"))):
            if k == 0 and n:
                starts, group = np.cumsum(np.frombuffer(own, np.int32, n), dtype=np.int64), np.frombuffer(own, np.int32, n, 4 * n)
                gone = shards.read_answers(replies, 2)[group] | np.unpackbits(np.frombuffer(own, np.uint8, -1, 8 * n), count=n).astype(bool)
                dropped = rolling.cover(starts[gone], window, len(dropped))
        ends = np.cumsum(counts)
        kept_text, digests, removed = [], [], []
        for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
            whole, out = texts.text(i), dropped[a:b]
            own, k = whole.split(), int(out.sum())
            if k:
                own = [own[j] for j in np.flatnonzero(~out).tolist()]
            kept = b" ".join(own)
            removed.append(k)
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_text.append((kept if k else whole).decode())
        return pa.table(
            [table.column("doc_id"), pa.array(counts), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_text, pa.string()), *map(table.column, names)],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *names],
        )

    by_shard = dealt.groupBy("shard")
    first = by_shard.applyInArrow(ask, shards.POST).groupBy("bucket").applyInArrow(shards.shared_by_shards, shards.REPLY)
    found = shared.written(by_shard.cogroup(first.groupBy("shard")).applyInArrow(locate, shards.POST), "windows")
    second = found.where("bucket >= 0").groupBy("bucket").applyInArrow(shards.earliest_owner, shards.REPLY)
    own = found.where("bucket < 0").select("shard", F.lit(0).alias("kind"), "bucket", "n", "body")
    return by_shard.cogroup(second.unionByName(own).groupBy("shard")).applyInArrow(remove, result).withColumnsRenamed(dict(zip(names, keep)))
