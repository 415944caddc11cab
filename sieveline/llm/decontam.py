"""Benchmark decontamination by spaced seeds.

Fixed masks pick some of the positions of a short span of words and ignore the
rest; they are chosen so that no pattern of substitutions in up to a fifth of the
words spoils all seeds of a passage.  Seeds of the benchmark are looked up at every
position of every document; each hit is then verified along its diagonal, where a
share of the words must agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import shards
from sieveline.llm.rolling import mix
from sieveline.llm.substring_dedup import words

# Spaced seeds (1: compared, 0: ignored) by the words that have to be compared; fewer are one seed of all
# words.  Wherever 80 % of so many words or more agree, one of the seeds lies on words that agree.
SEEDS = {
    5: ("1111", "10111", "11011", "11101"),
    6: ("1111", "11011"),
    7: ("11111", "110111", "111011"),
    8: ("11111", "110111"),
    9: ("1101111", "1111011"),
    10: ("11111", "110111", "11001011"),
    11: ("1101011", "1100111"),
    12: ("1101111", "111010011", "11100100011"),
}
#: Verification looks for this many words in a row (or the whole item, if it has fewer), of which this share agrees.
STRETCH, AGREE = 24, 0.8
#: A verbatim run of this many words (or the whole item, if it has fewer) is enough; where a document's end cuts the stretch short, at least this many words must be left.
RUN = 12
#: Hits that are compared at a time.
HITS = 1 << 16
#: Characters of benchmark text that one pass over the documents carries.
BLOCK_CHARS = 8 << 20
RESULT = "doc_id long, item_id long, first_word long, n_compared long, n_agreed long"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)]] = True
_BLANK = bytes(c if _LETTER[c] else 0x20 for c in range(256))


class _Words:
    """Hashes of the words (lower case, runs of letters and digits) of some texts."""

    def __init__(self, texts: list):
        bodies = [(t or "").lower().encode().translate(_BLANK) for t in texts]
        table = pa.table({"doc_id": pa.array(np.arange(len(bodies))), "text": pa.array(bodies, pa.binary())})
        self.hashes, self.counts = words(shards.Texts(table))
        self.ends = np.cumsum(self.counts)
        self.begins = self.ends - self.counts


def _seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask's positions, at each place."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(mask):
            if c == "1":
                total += hashes[j : j + n] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 2**64))
        return mix(total, int(mask, 2))


def masks(n: int) -> tuple[str, ...]:
    """Seeds that find every passage of ``n`` words or more of which 80 % agree."""
    return SEEDS[min(n, max(SEEDS))] if n >= min(SEEDS) else ("1" * n,)


class Index:
    """Seeds of some benchmark items, by the words of each that have to be compared."""

    def __init__(self, items: list[tuple[int | None, str]], stretch: int = STRETCH):
        self.ids = [i for i, _ in items]
        own = _Words([t for _, t in items])
        self.hashes, self.begins, self.counts = own.hashes, own.begins, own.counts
        self.tables = []
        by_mask: dict[str, list] = {}
        for k, (a, b) in enumerate(zip(own.begins, own.ends)):
            for m in masks(min(RUN, stretch, int(b - a))) if b > a else ():
                by_mask.setdefault(m, []).append((k, _seeds(own.hashes[a:b], m)))
        for m, rows in by_mask.items():
            seed = np.concatenate([s for _, s in rows])
            item = np.concatenate([np.full(len(s), k, np.int32) for k, s in rows])
            place = np.concatenate([np.arange(len(s), dtype=np.int32) for _, s in rows])
            order = np.argsort(seed, kind="stable")
            size = max(10, math.ceil(math.log2(len(seed))) + 6)
            sieve = np.zeros(1 << size, bool)
            sieve[seed >> np.uint64(64 - size)] = True
            self.tables.append((m, seed[order], item[order], place[order], size, sieve))

    def hits(self, own: _Words):
        """Arrays of (document, item, diagonal) whose seeds agree, mask by mask, about HITS at a time; some come again."""
        for mask, seed, item, place, size, sieve in self.tables:
            here = _seeds(own.hashes, mask)
            at = np.flatnonzero(sieve[here >> np.uint64(64 - size)])
            low = np.searchsorted(seed, here[at], "left")
            times = np.searchsorted(seed, here[at], "right") - low
            at, low, times = at[times > 0], low[times > 0], times[times > 0]
            doc = np.searchsorted(own.ends, at, "right")
            inside = at + len(mask) <= own.ends[doc] if len(at) else np.zeros(0, bool)
            at, low, times, doc = at[inside], low[inside], times[inside], doc[inside]
            sums, k = np.cumsum(times), 0
            while k < len(at):
                to = max(k + 1, int(np.searchsorted(sums, (sums[k - 1] if k else 0) + HITS, "right")))
                n = times[k:to]
                each = np.repeat(low[k:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield np.unique(np.stack([np.repeat(doc[k:to], n), item[each], np.repeat(at[k:to], n) - place[each]], 1), axis=0)
                k = to

    def verified(self, own: _Words, stretch: int, agree: float):
        """(document, item, first word of it, words compared, words that agree), the best diagonal of each pair."""
        best: dict[tuple[int, int], tuple] = {}
        for found in self.hits(own):
            at = 0
            sizes = np.cumsum(self.counts[found[:, 1]])
            while at < len(found):  # as many at a time as have about 16 words a hit, so long items stay within memory
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 16 * HITS, "right")))
                for row in self._agreeing(own, found[at:to], stretch, agree):
                    if row[1:] > best.get(row[0], (-1,)):
                        best[row[0]] = row[1:]
                at = to
        for (doc, item), (agreed, first, compared) in sorted(best.items()):
            yield doc, item, -first - int(own.begins[doc]), compared, agreed

    def _agreeing(self, own: _Words, found: np.ndarray, stretch: int, agree: float):
        """((document, item), words that agree, -first word, words compared) of the hits that hold."""
        doc, item, diagonal = found.T
        a = np.maximum(diagonal, own.begins[doc])
        size = np.minimum(diagonal + self.counts[item], own.ends[doc]) - a
        run = np.minimum(min(RUN, stretch), self.counts[item])
        keep = size >= run
        doc, item, diagonal, a, size, run = (x[keep] for x in (doc, item, diagonal, a, size, run))
        if not len(doc):
            return
        need, ends = np.minimum(stretch, size), np.cumsum(size)
        begins = ends - size
        inner = np.arange(ends[-1]) - np.repeat(begins, size)
        same = own.hashes[np.repeat(a, size) + inner] == self.hashes[np.repeat(self.begins[item] + a - diagonal, size) + inner]
        sums = np.concatenate(([0], np.cumsum(same)))
        at, left = np.arange(ends[-1]), np.repeat(size, size) - inner

        def most(width):  # of each hit, the most that agree in a row of so many words
            wide = np.repeat(width, size)
            return np.maximum.reduceat(np.where(left >= wide, sums[np.minimum(at + wide, ends[-1])] - sums[at], 0), begins)

        for k in np.flatnonzero((most(need) >= agree * need) | (most(run) == run)):
            yield (int(doc[k]), int(item[k])), int(sums[ends[k]] - sums[begins[k]]), -int(a[k]), int(size[k])


def overlaps(docs: DataFrame, benchmark: DataFrame, stretch: int = STRETCH, agree: float = AGREE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Pairs of documents and benchmark items that share a passage, substitutions allowed.

    A passage is ``stretch`` words in a row of which the share ``agree`` agrees, or
    ``RUN`` words that all agree (none is lost if ``agree`` is 0.8 or more); at a
    document's end or begin, the words of the stretch that the document has, ``RUN``
    at least.  One row per (document row, item): where the item (or what the document
    has of it) begins in the document, how many words could be compared and how many
    agree.  Null and empty texts and items match nothing; null ids are carried as they
    are; repeated rows give repeated pairs; an empty table on either side gives no row;
    extra columns are not read, whatever their names.  A benchmark beyond
    ``block_chars`` is taken in blocks, each of them against all documents.
    """
    sizes = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    blocks = max(1, math.ceil(sizes[0] / block_chars))
    out = None
    for k in range(blocks):
        block = benchmark.select("item_id", "text").where("text is not null").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        index = docs.sparkSession.sparkContext.broadcast(Index(sorted(((r.item_id, r.text) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])), stretch))

        def search(tables, index=index):
            for table in (part for t in tables for part in shards.slices(t)):
                ids = table.column("doc_id").to_pylist()
                rows = [(ids[d], index.value.ids[i], *rest) for d, i, *rest in index.value.verified(_Words(table.column("text").to_pylist()), stretch, agree)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "first_word", "n_compared", "n_agreed"])

        found = docs.select("doc_id", "text").mapInArrow(search, RESULT)
        out = found if out is None else out.unionByName(found)
    return out
