"""Jaccard join of word 5-gram sets by PartEnum signatures.

Sets of alike sizes form bands; a set stands in the band of its size, and takes
part in two joins: with its own band and the next one, and with the band below.
For a pair of a join the symmetric difference is at most k.  The domain of
shingles is hashed into first-level parts, each into sub-parts; in at least one
first-level part a linked pair differs in at most k2 places, so that some subset
of its sub-parts is the same in both.  A signature is the content of such a subset.

Extra first-level parts make up for subsets without any shingle, which are left
out; a set that has more of them than that also gets prefix-filter signatures,
which only such sets share.  So no link is missed.

Exact copies of a set are one class before any signature is made.  Members of a
signature's group are verified against its smallest member, each pair once: the
groups with one smallest member make its star.  Only those it is not linked with,
directly or through others, are tested against the rest of the star, and of these
only those with enough shingles that others have.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import rolling, shards, shared
from sieveline.llm.substring_dedup import words

SHINGLE, SIMILARITY, SHARD_BYTES = 5, 80, 4 << 20
#: 64-bit words of a set's sketch: the parity of its shingles' numbers in as many bits.
SKETCH = 8
SETS = "doc_id long, n_shingles long, key1 long, key2 long, " + ", ".join(f"s{i} long" for i in range(SKETCH))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_U = np.uint64


class Shingles:
    """Distinct shingle hashes of each document: ``values`` end to end, each document's sorted."""

    def __init__(self, texts: shards.Texts, width: int = SHINGLE):
        texts.data = _LOWER[texts.data]
        hashes, counts = words(texts)
        n = len(texts)
        ends = np.cumsum(counts)
        prefix = rolling.Prefix(hashes)
        valid = np.flatnonzero(rolling.valid_starts(counts, width)[: max(0, len(hashes) - width + 1)])
        owner = np.repeat(np.arange(n), counts)[valid]
        value = prefix.every(width)[valid] if len(valid) else np.zeros(0, np.uint64)
        # fewer words than a shingle: the whole sequence is one
        short = np.flatnonzero((counts > 0) & (counts < width))
        whole = [rolling.mix(prefix.at(np.array([ends[i] - counts[i]]), int(counts[i])), 1 + int(counts[i])) for i in short]
        owner = np.concatenate([owner, short])
        value = np.concatenate([value, *whole])
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        new = np.ones(len(value), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        self.owner, self.values = owner[new], value[new]
        self.sizes = np.bincount(self.owner, minlength=n).astype(np.int64)
        self.ends = np.cumsum(self.sizes)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each set, whatever its order."""
        out = []
        for seed in (11, 12):
            sums = np.concatenate(([_U(0)], np.cumsum(rolling.mix(self.values, seed), dtype=np.uint64)))
            with np.errstate(over="ignore"):
                out.append(rolling.mix(sums[self.ends] - sums[self.ends - self.sizes]).view(np.int64))
        return out[0], out[1]

    def sketches(self) -> np.ndarray:
        """A row of ``SKETCH`` words for each set; two sets differ in as many shingles as their sketches do in bits, or more."""
        bit = (rolling.mix(self.values, 13) % _U(64 * SKETCH)).astype(np.int64)
        words_ = np.zeros(len(self.sizes) * SKETCH, np.uint64)
        np.bitwise_xor.at(words_, self.owner * SKETCH + (bit >> 6), _U(1) << (bit & 63).astype(np.uint64))
        return words_.view(np.int64).reshape(-1, SKETCH)

    def subset(self, mask: np.ndarray) -> "Shingles":
        """The sets of the documents in ``mask``."""
        out = object.__new__(Shingles)
        keep = mask[self.owner]
        out.owner = (np.cumsum(mask) - 1)[self.owner[keep]]
        out.values = self.values[keep]
        out.sizes = self.sizes[mask]
        out.ends = np.cumsum(out.sizes)
        return out


def band_tops(largest: int, similarity: int = SIMILARITY) -> np.ndarray:
    """The largest size of each band: r, with every partner of a smaller set in the band within r / similarity."""
    tops = [1]
    while tops[-1] < largest:
        tops.append((tops[-1] + 1) * 100 // similarity)
    return np.array(tops, np.int64)


def layout(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bound of the difference: first-level parts, and how many of them may have an empty subset."""
    extra = np.where(k > 3, 2 + -(-(k // 2 + 1) // 20), 0)
    return np.where(k > 3, k // 2 + 1 + extra, 1), extra


def signatures(sets: Shingles, similarity: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document) of all sets."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    n = len(sets.sizes)
    if not len(sets.values):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tops = band_tops(int(sets.sizes.max()), similarity)
    band = np.searchsorted(tops, sets.sizes)
    spread = rolling.mix(sets.values, 21)
    content = rolling.mix(sets.values, 22)
    far, near = spread >> _U(32), spread & _U(0xFFFFFFFF)
    for role in (0, 1):  # with its own band and the next; with the band below
        tag = band + 1 - role
        top = np.where(tag > 0, tops[np.maximum(tag - 1, 0)], 0)
        # (a + b) * (1 - s) / (1 + s) with a <= top and b <= a / s
        k = np.where(sets.sizes > 0, top * (100 - similarity) // similarity, 0)
        parts, extra = layout(k)
        for small in (1, 2, 3, 0):
            chosen = (k == small) if small else (k > 3)
            if not chosen.any():
                continue
            subs = small + 3 if small else 3
            keep = small or 1  # k2
            subsets = list(combinations(range(subs), subs - keep))
            docs = np.flatnonzero(chosen)
            base = np.zeros(n, np.int64)
            base[docs] = np.cumsum(parts[docs]) - parts[docs]
            total = int(parts[docs].sum())
            own = chosen[sets.owner]
            of = sets.owner[own]
            part = ((far[own] * parts[of].astype(np.uint64)) >> _U(32)).astype(np.int64)
            cell = (base[of] + part) * subs + (near[own] % _U(subs)).astype(np.int64)
            sums = np.zeros(total * subs, np.uint64)
            np.add.at(sums, cell, content[own])
            full = np.bincount(cell, minlength=total * subs).reshape(total, subs) > 0
            sums = sums.reshape(total, subs)
            who = np.repeat(docs, parts[docs])
            which = np.arange(total) - base[who]
            empty = np.zeros(total, bool)
            for s, subset in enumerate(subsets):
                some = full[:, subset].any(1)
                empty |= ~some
                with np.errstate(over="ignore"):
                    label = rolling.mix((tag[who].astype(np.uint64) << _U(40)) | (which.astype(np.uint64) << _U(8)) | _U(s), 23)
                    value = label.copy()
                    for u in subset:
                        value = rolling.mix(value + sums[:, u], 24 + u)
                found.append((value[some], who[some]))
            lacking = np.bincount(who[empty], minlength=n)
            for d in np.flatnonzero(lacking > extra):
                m = int(sets.sizes[d])
                prefix = sets.values[sets.ends[d] - m : sets.ends[d]][: m - -(-m * similarity // 100) + 1]
                found.append((rolling.mix(prefix + rolling.mix(np.full(len(prefix), tag[d], np.uint64), 31), 32), np.full(len(prefix), d)))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([s for s, _ in found]), np.concatenate([d for _, d in found])


def describe(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, key1, key2, sketch words) of each row; sets with equal keys are the same set."""

    def keys(tables):
        for t in (part for batch in tables for part in shards.slices(batch)):
            sets = Shingles(shards.Texts(pa.Table.from_batches([t])), width)
            columns = [sets.sizes, *sets.keys(), *sets.sketches().T]
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in columns)], ["doc_id", "n_shingles", "key1", "key2", *(f"s{i}" for i in range(SKETCH))])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(keys, SETS)


def _groups(docs: DataFrame, reps: DataFrame, shard_bytes: int, width: int, similarity: int) -> DataFrame:
    """(signature, doc_id, null): members of the signatures that two or more sets share; (null, doc_id, body): the sorted shingles of each member."""
    n, bits = shards.plan_shards(docs, "text", shard_bytes)
    by_shard = shards.deal(docs.where("doc_id is not null"), n, by_text=False).groupBy("shard")
    chosen = reps.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("long").alias("shard"), F.lit(0).alias("kind"), F.col("doc_id").alias("bucket"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("body"))

    def signed(table, extra):
        texts = shards.Texts(table)
        kinds = np.asarray(extra.column("kind").combine_chunks())
        ids = np.asarray(extra.column("bucket").combine_chunks())[kinds == 0]
        # each class once, even where rows repeat its id
        first = np.zeros(len(texts), bool)
        first[np.unique(texts.ids, return_index=True)[1]] = True
        rep = np.isin(texts.ids, ids) & texts.known
        if rep.sum() != (rep & first).sum():
            sets = Shingles(texts, width)
            wanted = {(r["bucket"], r["body"]) for r in extra.to_pylist() if r["kind"] == 0}
            for i in np.flatnonzero(rep):
                mark = (int(texts.ids[i]), b"")
                rep[i] = mark in wanted
                wanted.discard(mark)
        else:
            sets = Shingles(texts, width)
        sets = sets.subset(rep)
        return texts.ids[rep], sets, *signatures(sets, similarity)

    def ask(key, table, extra):
        ids, _, values, owner = signed(table, extra)
        return shards.recurrence_posts(key[0].as_py(), bits, *shards.recurrence(bits, values, ids[owner]))

    def emit(key, table, extra):
        ids, sets, values, owner = signed(table, extra)
        v, _ = shards.recurrence(bits, values, ids[owner])
        shared_ = v[shards.read_answers(extra, 1)]
        cut = values >> _U(32 - bits)
        at = np.minimum(np.searchsorted(shared_, cut), max(len(shared_) - 1, 0))
        hit = shared_[at] == cut if len(shared_) else np.zeros(len(cut), bool)
        members = np.unique(owner[hit])
        bodies = sets.subset(np.isin(np.arange(len(ids)), members))
        cuts = np.concatenate((np.zeros(hit.sum(), np.int32), [0], bodies.ends)).astype(np.int32)
        none = np.concatenate((np.ones(hit.sum(), bool), np.zeros(len(members), bool)))
        return pa.table(
            [
                pa.array(np.concatenate((values[hit].view(np.int64), np.zeros(len(members), np.int64))), mask=~none),
                pa.array(np.concatenate((ids[owner[hit]], ids[members]))),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(bodies.values.view(np.int64)), mask=pa.array(none)),
            ],
            names=["signature", "doc_id", "body"],
        )

    replies = by_shard.cogroup(chosen.groupBy("shard")).applyInArrow(ask, shards.POST).groupBy("bucket").applyInArrow(shards.shared_by_shards, shards.REPLY)
    return by_shard.cogroup(chosen.unionByName(replies).groupBy("shard")).applyInArrow(emit, "signature long, doc_id long, body array<long>")


def _verify(pairs: DataFrame, bodies: DataFrame, similarity: int) -> DataFrame:
    """(a, b, linked): whether 100 * intersection >= similarity * union, on whole sets."""

    def test(tables):
        for t in tables:
            out = []
            x, y = t.column("x"), t.column("y")
            for k in range(t.num_rows):
                one, other = x[k].values.to_numpy(), y[k].values.to_numpy()
                both = len(np.intersect1d(one, other, assume_unique=True))
                out.append(100 * both >= similarity * (len(one) + len(other) - both))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    # pairs and sets grow with the input: neither is broadcast
    right = pairs.hint("merge").join(bodies.select(F.col("doc_id").alias("b"), F.col("body").alias("y")), "b")
    both = right.hint("merge").join(bodies.select(F.col("doc_id").alias("a"), F.col("body").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(test, "a long, b long, linked boolean")


def _own_shingles(bodies: DataFrame) -> DataFrame:
    """(doc_id, own): how many shingles of a document no other one of ``bodies`` has."""
    each = bodies.select("doc_id", F.explode("body").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    return alone.groupBy("doc_id").agg(F.count("*").alias("own"))


def _may_link(a: str, b: str, similarity: int):
    """Sizes and sketches leave room for a link: |A| + |B| bounds the difference, the sketches' differing bits never exceed it.

    Columns: n and the sketch words, each with the prefix ``a`` or ``b``.
    """
    total = F.col(f"{a}n") + F.col(f"{b}n")
    differ = sum((F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col(f"{a}s0").bitwiseXOR(F.col(f"{b}s0"))))
    sizes = F.least(F.col(f"{a}n"), F.col(f"{b}n")) * 100 >= F.greatest(F.col(f"{a}n"), F.col(f"{b}n")) * similarity
    return sizes & (differ * (100 + similarity) <= total * (100 - similarity))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, for all nodes of ``links`` (a, b).

    Labels spread along links and jump to their label's label; every round is
    checkpointed in the shared folder.  Nothing but a count reaches the driver.
    """
    shared.folder(links.sparkSession)
    edges = links.select("a", "b").union(links.select("b", "a")).distinct().checkpoint()
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")).checkpoint()
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        step = labels.join(heard, "node").select("node", "component", F.least("component", "heard").alias("low"))
        ahead = labels.select(F.col("node").alias("low"), F.col("component").alias("beyond"))
        step = step.join(ahead, "low", "left").select("node", F.col("component").alias("old"), F.least("low", "beyond").alias("component")).checkpoint()
        changed = step.where("old <> component").limit(1).count()
        labels = step.drop("old")
        if not changed:
            return labels


def _chosen(docs: DataFrame, clashing: DataFrame, width: int) -> DataFrame:
    """``docs`` with one row of each doc_id in ``clashing`` (doc_id, key1, key2): one whose set has these keys."""

    def keyed(tables):
        for t in (part for batch in tables for part in shards.slices(batch)):
            keys = Shingles(shards.Texts(pa.Table.from_batches([t])), width).keys()
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), t.column("text"), *map(pa.array, keys)], ["doc_id", "text", "key1", "key2"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    some = texts.join(clashing.select("doc_id"), "doc_id", "left_semi").mapInArrow(keyed, "doc_id long, text string, key1 long, key2 long")
    some = some.join(clashing, ["doc_id", "key1", "key2"], "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts.join(clashing.select("doc_id"), "doc_id", "left_anti").unionByName(some)


def join(docs: DataFrame, similarity: int = SIMILARITY, width: int = SHINGLE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id that links reach).

    Words are runs without ASCII white space, A-Z in lower case.  Null, empty and
    blank texts have an empty set and are linked with nothing, not even each other.
    Rows with a null doc_id keep a null component and link nothing.  Rows that share
    a doc_id count as one document for links, by their smallest set key.  An empty
    table gives no row; extra columns are not read, whatever their names.
    """
    sets = shared.written(describe(docs, width), "sets")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    # ids with two sets or more: everything below sees one row of each, that of the smallest key
    own = full.groupBy("doc_id").agg(F.min(F.struct("key1", "key2")).alias("low"), F.max(F.struct("key1", "key2")).alias("high"))
    blank = sets.where("n_shingles = 0").select("doc_id").distinct()
    clashing = own.join(blank.withColumn("blank", F.lit(True)), "doc_id", "left").where("low <> high or blank").select("doc_id", "low.key1", "low.key2")
    clashing = shared.written(clashing, "clashing")
    if clashing.limit(1).count():
        full = full.join(clashing.select("doc_id"), "doc_id", "left_anti").unionByName(full.join(clashing, ["doc_id", "key1", "key2"], "left_semi").select(*full.columns))
        docs = _chosen(docs, clashing, width)
    # tables that are joined by keys which a third of all rows may have are written first: Spark can then split such a key
    classes = shared.written(full.groupBy("key1", "key2").agg(F.min("doc_id").alias("class_id")), "classes")
    found = shared.written(_groups(docs, classes.select(F.col("class_id").alias("doc_id")).distinct(), shard_bytes, width, similarity), "groups")
    groups, bodies = found.where("signature is not null").select("signature", "doc_id"), found.where("signature is null").select("doc_id", "body")

    sketches = shared.written(full.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).drop("key1", "key2"), "sketches")

    def sketched(frame: DataFrame, c: str) -> DataFrame:
        """``frame`` with size and sketch of the document in column ``c``."""
        return frame.join(sketches.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"{c}n"), *(F.col(f"s{i}").alias(f"{c}s{i}") for i in range(SKETCH))), c)

    # every group against its smallest member: the star of that member, one row however many signatures are shared
    smallest = shared.written(groups.groupBy("signature").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).where("a < last").drop("last"), "smallest")
    stars = shared.written(groups.join(smallest, "signature").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "stars")
    first = sketched(sketched(stars, "a"), "b").where(_may_link("a", "b", similarity)).select("a", "b")
    first = shared.written(_verify(first, bodies, similarity), "first")
    links = first.where("linked").select("a", "b")
    near = components(links)

    # members that the smallest one does not reach, against the others of their star
    label = lambda frame, c: frame.join(near.select(F.col("node").alias(c), F.col("component").alias(f"{c}_near")), c, "left").withColumn(f"{c}_near", F.coalesce(f"{c}_near", c))
    labelled = shared.written(label(label(stars, "a"), "b").select("a", "b", F.col("b_near").alias("near"), (F.col("a_near") != F.col("b_near")).alias("apart")), "labelled")
    open_ = shared.written(labelled.where("apart").select("a").distinct(), "open")
    together = shared.written(labelled.join(open_, "a", "left_semi"), "together")
    # a document with too few shingles that any other of these stars' has is linked with none there
    own = _own_shingles(bodies.join(together.select(F.col("b").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"))
    rest = sketched(together, "b").join(own.withColumnRenamed("doc_id", "b"), "b", "left").withColumn("common", F.col("bn") - F.coalesce("own", F.lit(0))).drop("own")
    rest = shared.written(rest.where(F.col("common") * 100 >= F.col("bn") * similarity), "candidates")
    left = rest.where("apart").select(
        "a", F.col("b").alias("r"), F.col("bn").alias("rn"), *(F.col(f"bs{i}").alias(f"rs{i}") for i in range(SKETCH)), F.col("near").alias("r_near"), F.col("common").alias("r_common")
    )
    second = (
        left.join(rest, "a")
        .where((F.col("near") != F.col("r_near")) & (~F.col("apart") | (F.col("r") < F.col("b"))) & (F.least("common", "r_common") * (100 + similarity) >= (F.col("bn") + F.col("rn")) * similarity) & _may_link("r", "b", similarity))
        .select(F.least("r", "b").alias("a"), F.greatest("r", "b").alias("b"))
        .distinct()
        .join(first.select("a", "b"), ["a", "b"], "left_anti")
    )
    second = shared.written(_verify(second, bodies, similarity), "second")
    more = second.where("linked").select("a", "b")
    labels = components(links.union(more)) if more.limit(1).count() else near
    # what follows reads none of these
    shared.remove(found, sketches, smallest, stars, first, labelled, open_, together, rest, second)

    named = full.join(classes, ["key1", "key2"]).select("doc_id", "class_id").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    named = named.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select("doc_id", F.coalesce("component", "class_id").alias("component_id"))
    return sets.select("doc_id", "n_shingles").join(named, "doc_id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
