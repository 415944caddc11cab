"""The training-data operators against brute force, on small and awkward tables."""

import base64
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex as re
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sieveline.llm import decontam, encoding, fingerprints, ngram_join, packing, quality, queries, rolling, shards, substring_dedup, suffix_dedup, token_counts, training_order, warc

SMALL = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, shard string, n_words string, rank string, bucket string"


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def awkward_rows():
    """Copies, near copies, shared passages, periodic text, odd white space, nulls, ties, long texts."""
    base, shared = passage(1, 150), passage(2, 70)
    words = base.split()
    texts = [
        base, base, base.upper(), " ".join(words[:75] + ["zz"] + words[76:]), " ".join(words[:140]),
        f"{passage(3, 40)} {shared} {passage(4, 30)}", f"{shared}\n{passage(5, 60)}", f"{passage(6, 20)}\t\x0b{shared}",
        "of " * 300, "of " * 200, "ab" * 400, "é" * 120, "日本語のテキスト" * 30, "日本語のテキスト" * 20 + "終",
        "", None, " \n\t ", "one", "one two three four", "one two three four", "ONE two three four", passage(7, 4000),
        passage(7, 3000) + " " + passage(8, 100), "a\x00b " * 60, "nul\x1cword " * 60, "x y " * 24 + "x", "<|endoftext|> it's we'll 3½ İ ſ",
    ]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [(None, base), (None, None), (1, base), (4, shared)]  # null ids, repeated ids
    return [(d, t, "en", "s", None, "x", None, "y", "z") for d, t in rows]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), KIND).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


VOCABULARY = queries.vocabulary()


def removed(symbols, rows, width):
    """Mask of each row: covered by a window that also starts in a row with a smaller id."""
    first = {}
    for d, s in rows:
        if d is not None:
            for i in range(len(s) - width + 1):
                w = symbols(s[i : i + width])
                first[w] = min(first.get(w, d), d)
    for d, s in rows:
        gone = [False] * len(s)
        if d is not None:
            for i in range(len(s) - width + 1):
                if first[symbols(s[i : i + width])] < d:
                    gone[i : i + width] = [True] * width
        yield d, s, gone


@pytest.mark.parametrize("shard_bytes", [1500, 1 << 22])
def test_substring_dedup(awkward, shard_bytes):
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in awkward.collect()]
    expected = Counter((d, len(s), sum(g), hashlib.sha256(b" ".join(w for w, x in zip(s, g) if not x)).hexdigest()) for d, s, g in removed(tuple, rows, 50))
    found = substring_dedup.dedup(awkward, shard_bytes=shard_bytes, keep=("lang", "rank", "shard")).collect()
    assert {(r.lang, r.rank, r.shard) for r in found} == {("en", "y", "x")}
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == expected
    assert sum(r.n_removed for r in found) > 500
    originals = {(r.doc_id, r.text or "") for r in awkward.collect()}
    assert all((r.doc_id, r.kept_text) in originals for r in found if not r.n_removed)
    with pytest.raises(ValueError):
        substring_dedup.dedup(awkward, keep=("n_words",))


@pytest.mark.parametrize("shard_bytes", [1500, 1 << 22])
def test_substring_dedup_of_rows_in_any_order(awkward, shard_bytes):
    def moved(batches):  # another order at each reading, as a shuffle between executors has
        table = pa.Table.from_batches(batches)
        yield from table.take(np.random.default_rng().permutation(table.num_rows)).to_batches()

    def digests(docs):
        return Counter(substring_dedup.dedup(docs, shard_bytes=shard_bytes, keep=("rank",)).collect())

    assert digests(awkward.coalesce(1).mapInArrow(moved, awkward.schema)) == digests(awkward)


def test_substring_dedup_needs_its_automata(awkward, empty, monkeypatch):
    assert substring_dedup.dedup(empty).count() == 0
    docs = awkward.where("doc_id < 50").coalesce(1)
    shard = substring_dedup._Shard(pa.Table.from_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).toArrow().to_batches()), 50, 8)
    starts, _ = rolling.runs(shard.minima, shard.valid)
    phrases = shard.phrases(0, np.unique(rolling.mix(shard.minima[starts], 9) >> np.uint64(32)))
    grams = shard.prefix.every(8)
    # every place of every phrase, and no window without one
    ends = np.cumsum(shard.counts)
    inside = [p for a, b in zip(ends - shard.counts, ends) if b - a >= 50 for p in range(a, b - 7)]
    assert sorted(shard.occurrences(phrases).tolist()) == [p for p in inside if grams[p] in set(grams[phrases].tolist())]
    assert shard.around(shard.occurrences(phrases)).tolist() == np.flatnonzero(shard.valid).tolist()
    assert len(shard.around(np.zeros(0, np.int64))) == 0


def test_words_of_any_length():
    pieces = ["a", "a\x00", "ab" * 4, "ab" * 4 + "c", "x" * 63, "x" * 64, "x" * 65, "x" * 66, "日本" * 40, "日本" * 40 + "語", "y" * 5000]
    table = pa.table({"doc_id": [1, 2, 3], "text": [" ".join(pieces), "\n".join(reversed(pieces)), ""]})
    hashes, counts = substring_dedup.words(shards.Texts(table))
    assert counts.tolist() == [len(pieces), len(pieces), 0]
    assert hashes[: len(pieces)].tolist() == hashes[len(pieces) :][::-1].tolist() and len(set(hashes.tolist())) == len(pieces)


@pytest.mark.parametrize(("shard_bytes", "hot"), [(1500, suffix_dedup.HOT), (1500, 3), (1 << 22, 2), (1 << 22, 1)])
def test_suffix_dedup(awkward, shard_bytes, hot):
    rows = [(r.doc_id, (r.text or "").encode()) for r in awkward.collect()]
    expected = Counter()
    for d, s, g in removed(bytes, rows, 50):
        spans = sum(x and not (i and g[i - 1]) for i, x in enumerate(g))
        expected[d, len(s), sum(g), spans, hashlib.sha256(bytes(b for b, x in zip(s, g) if not x)).hexdigest()] += 1
    found = suffix_dedup.dedup(awkward, shard_bytes, hot).collect()
    assert suffix_dedup.dedup(awkward.where("false")).count() == 0 and ngram_join.join(awkward.where("false")).count() == 0
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == expected


def test_second_minima():
    r = np.random.default_rng(6)
    data = np.concatenate((r.integers(97, 100, 300), np.full(80, 97), np.tile(r.integers(97, 100, 20), 8))).astype(np.uint8)
    own, first = suffix_dedup.grams(data), suffix_dedup.minima(data)
    for i, second in enumerate(suffix_dedup.second_minima(data, np.arange(len(first)), first).tolist()):
        window = set(own[i : i + 35].tolist())
        assert second == min(window - {int(first[i])}, default=2**64 - 1) and first[i] == min(window)


def test_merge_of_transforms():
    """Many shards, one of them hot: the smallest owner of each window."""
    r = random.Random(3)
    parts = [bytes(r.choice(b"ab") for _ in range(60)) for _ in range(5)]
    texts = [b"".join(r.choice(parts) for _ in range(r.randint(1, 3)))[r.randint(0, 9) :] for _ in range(80)]
    owners = np.array([r.randint(0, 30) for _ in texts])
    lengths = np.array([len(t) for t in texts])
    out = suffix_dedup.merge(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths, owners, transform_rows=300)
    least = {}
    for t, o in zip(texts, owners):
        for i in range(len(t) - 49):
            least[t[i : i + 50]] = min(least.get(t[i : i + 50], o), o)
    at = 0
    for t in texts:
        assert out[at : at + max(0, len(t) - 49)].tolist() == [least[t[i : i + 50]] for i in range(len(t) - 49)]
        at += len(t) + 1


def shingles(text):
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    w = [x.translate(lower) for x in (text or "").encode().split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def component_ids(sets):
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: top(d) for d in sets}


def near_copies(seed, n):
    r = random.Random(seed)
    rows, texts = [], [passage(seed + k, k) for k in (5, 6, 7, 9, 12, 16, 20, 25, 33, 60, 150, 400)]
    for d in range(n):
        w = r.choice(texts).split()
        for _ in range(r.randint(0, 1 + len(w) // 25)):
            w[r.randrange(len(w))] = "w" + str(r.randrange(9))
        rows.append((d, " ".join(w)))
    return rows


def test_ngram_join(spark, documents):
    kind = "doc_id long, text string"
    for rows in (near_copies(5, 150), near_copies(6, 150), [(r.doc_id, r.text) for r in documents.collect()]):
        sets = {d: shingles(t) for d, t in rows}
        expected = component_ids(sets)
        found = ngram_join.join(spark.createDataFrame(rows, kind).repartition(3), shard_bytes=20_000).collect()
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == {(d, len(sets[d]), expected[d]) for d in sets}


def test_ngram_join_awkward(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    found = ngram_join.join(awkward).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in found) == Counter((d, len(shingles(t))) for d, t in rows)
    by = {r.doc_id: r.component_id for r in found if r.n_shingles}
    assert by[1] == by[4] == by[7] == by[10] == 1  # copies, other case, one word changed
    assert by[55] == by[58] == by[61] == 55
    assert all(r.component_id is None for r in found if r.doc_id is None)
    assert {r.component_id for r in found if r.doc_id in (43, 46, 49)} == {43, 46, 49}


def test_ngram_join_clashing_ids(spark):
    """Rows of one id with different texts: all steps take the text of the smallest set key, whatever the order of rows."""
    texts = [passage(300 + k, 60) for k in range(8)]
    near = lambda t: " ".join(["zz", *t.split()[1:]])
    table = pa.table({"doc_id": list(range(8)), "text": texts})
    keys = list(zip(*(k.tolist() for k in ngram_join.Shingles(shards.Texts(table)).keys())))
    rows, expected = [], {}
    for k in range(0, 8, 2):  # id 10 + k has two texts; each has a near copy with a smaller and one with a larger id
        low, high = sorted((k, k + 1), key=keys.__getitem__)
        for order in ((low, high), (high, low)):
            d = 100 * (1 + (order[0] == low)) + 10 * k
            rows += [(d + 5, texts[order[0]]), (d + 5, texts[order[1]]), (d + 5, None), (d + 6, near(texts[low])), (d + 7, near(texts[high]))]
    sets = {d: shingles(t) for d, t in rows if d % 10 != 5}
    for d, t in rows:
        if d % 10 == 5 and t and keys[texts.index(t)] == min(keys[texts.index(x)] for e, x in rows if e == d and x):
            sets[d] = shingles(t)
    expected = component_ids(sets)
    for cut in (rows, rows[::-1]):
        found = ngram_join.join(spark.createDataFrame(cut, "doc_id long, text string").coalesce(1), shard_bytes=20_000).collect()
        assert {(r.doc_id, r.component_id) for r in found if r.n_shingles} == set(expected.items())
        assert Counter((r.doc_id, r.n_shingles) for r in found) == Counter((d, len(shingles(t))) for d, t in rows)


def test_signatures_find_every_linked_pair():
    """Sets at the very bound of the similarity share a signature, for all sizes."""
    r = np.random.default_rng(1)
    for size in [*range(5, 60), 75, 100, 240, 700, 2000]:
        for _ in range(3):
            union = r.integers(0, 2**63, size, dtype=np.uint64)
            both = -(-size * 80 // 100)
            cut = both + int(r.integers(0, size - both + 1))
            a, b = np.sort(union[:cut]), np.sort(np.concatenate((union[:both], union[cut:])))
            sets = object.__new__(ngram_join.Shingles)
            sets.values, sets.sizes = np.concatenate((a, b)), np.array([len(a), len(b)])
            sets.owner, sets.ends = np.repeat([0, 1], sets.sizes), np.cumsum(sets.sizes)
            values, owner = ngram_join.signatures(sets)
            shared = np.intersect1d(values[owner == 0], values[owner == 1])
            assert len(shared) or len(a) == len(b) == both, size
            words = sets.sketches().view(np.uint64)
            assert np.bitwise_count(words[0] ^ words[1]).sum() <= size - both


def test_quality(spark, documents, awkward, empty):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.classify(documents, labels).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in documents.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    for kind, least in ((0, 0.8), (1, 0.9)):  # recall of each label, held out or not
        right = [r.predicted == kind for r in rows if known.get(r.doc_id) == kind]
        assert sum(right) >= least * len(right)
    model = quality.fit(documents, labels)
    assert 0.5 < model.prior < 0.95
    assert quality.score(awkward, model).count() == awkward.count() and quality.score(empty, model).count() == 0
    assert {r.score for r in quality.classify(documents, labels.where("false")).collect()} == {0.5}
    kept = quality.accepted(awkward, model)
    assert kept.columns == awkward.columns


def test_quality_held_out(spark):
    """On a larger table, recall of each label among the held-out documents."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality.classify(docs, labels).collect() if r.held_out]
    for kind in (0, 1):
        right = [r.predicted == kind for r in rows if known.get(r.doc_id) == kind]
        assert len(right) > 5 and sum(right) >= 0.9 * len(right)


def test_estimated_prior():
    r = np.random.default_rng(1)
    for prior in (0.3, 0.6, 0.85):
        draw = lambda n, share: r.normal(size=(n, 4)) + np.where(r.random(n) < share, 2.0, -2.0)[:, None] * [1, 0.5, 0, 0]
        p, u = draw(2000, 1), draw(5000, prior)
        assert prior - 0.08 < quality.estimated_prior(p, u, np.arange(2000) % 2, np.arange(5000) % 2) < prior + 0.03


def test_quality_ignores_held_out_labels(spark, documents):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(documents, labels), quality.fit(documents, flipped)
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_encoder(library):
    r = random.Random(2)
    alphabet = [chr(c) for c in range(1, 0x250)] + list("'s'll'd 've 123²½ªº　日本") * 6
    texts = ["".join(r.choice(alphabet) for _ in range(30)) for _ in range(400)] + [t[1] or "" for t in awkward_rows()]
    texts += ["".join(c for c in t if encoding._PLAIN.fullmatch(c)) for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoding.encoder(VOCABULARY).encode(texts)] == [library(t) for t in texts]


def test_token_counts(awkward, empty, library):
    sizes = [len(library(r.text)) for r in awkward.collect()]
    rows = token_counts.counts(awkward, VOCABULARY).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == Counter(sizes)
    for r in rows:
        assert r.docs_at_least == sum(s >= r.n_tokens for s in sizes)
        assert r.tokens_at_least == sum(s for s in sizes if s >= r.n_tokens)
        assert r.truncated_total == sum(min(s, r.n_tokens) for s in sizes)
        assert math.isclose(r.docs_share, sum(s <= r.n_tokens for s in sizes) / len(sizes))
    at = {r.context_limit: r.truncated_total for r in token_counts.at_limits(token_counts.histogram(awkward, VOCABULARY), [1, 100, 10**6]).collect()}
    assert at == {n: sum(min(s, n) for s in sizes) for n in at}
    assert token_counts.counts(empty, VOCABULARY).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_permutation(size):
    assert sorted(training_order.permute(np.arange(size), size).tolist()) == list(range(size))
    if size > 100:
        assert training_order.permute(np.arange(size), size, 1).tolist() != training_order.permute(np.arange(size), size, 2).tolist()


def test_training_order(spark, awkward, empty, library, tmp_path):
    expected = Counter()
    for r in awkward.collect():
        ids = library(r.text)
        for s, a in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[a : a + 64], "<u2").tobytes()
            expected[-1 if r.doc_id is None else r.doc_id, s, len(part) // 2, zlib.crc32(part)] += 1
    path = str(tmp_path / "order")
    total = training_order.materialise(awkward, VOCABULARY, path, length=64, slots=16)
    table = spark.read.parquet(path)
    rows = training_order.read(table).collect()
    assert Counter((r.doc_id, r.sequence, r.n_ids, r.ids_crc32) for r in rows) == expected
    assert sorted(r.slot for r in rows) == list(range(total))
    assert all(r.slot == r.shard * 16 + r.byte_offset // 128 for r in rows)
    assert sorted(r.slot for r in training_order.read(table, 21).collect()) == list(range(21, total))
    assert training_order.round_trip(empty, VOCABULARY).count() == 0


def test_training_order_is_a_function_of_key_and_corpus(spark, awkward, documents):
    for docs in (awkward, documents.select("doc_id", "text")):
        rows = [training_order.round_trip(d, VOCABULARY, length=64).select("slot", "doc_id", "sequence", "ids_crc32").collect() for d in (docs.coalesce(1), docs.repartition(3), docs.orderBy(F.desc("doc_id")))]
        assert set(rows[0]) == set(rows[1]) == set(rows[2]) and len(rows[0]) > 100
    other = training_order.round_trip(awkward, VOCABULARY, length=64, key=5).select("slot", "doc_id", "sequence").collect()
    assert {(r.slot, r.doc_id, r.sequence) for r in other} != {(r.slot, r.doc_id, r.sequence) for r in training_order.round_trip(awkward, VOCABULARY, length=64).collect()}


def test_fingerprints(awkward, empty, documents):
    rows = fingerprints.compare_edited(awkward).collect()
    ordered = sorted(awkward.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    expected = Counter()
    for k, r in enumerate(ordered):
        text, after = r.text or "", ordered[(k + 1) % len(ordered)].text or ""
        half = len(text) // 2
        expected[r.doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == expected
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    marks = defaultdict(set)
    for r in fingerprints.fingerprints(documents).join(documents.select("doc_id", "text"), "doc_id").collect():
        marks[r.text].add(r.fingerprint)
    assert all(len(m) == 1 for m in marks.values())
    big = fingerprints.compare_edited(documents).agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert big.e > 5 * big.n
    assert fingerprints.compare_edited(empty).count() == 0


def test_fingerprints_equal_brute_force(spark, documents, awkward):
    """The same parts from Python sets: exact band, subsets by hash, likeness."""
    term = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest()
    terms_of = lambda text: {term(t) for t in re.split(r"[^\p{L}\p{N}]+", text.lower()) if t}

    def mark(terms):
        h = 42
        for t in sorted(terms, key=lambda t: t - 2**64 if t >= 2**63 else t):
            h = xxhash.xxh64(t.to_bytes(8, "little"), seed=h).intdigest()
        return f"{h & 0xFFFFFFFF:x}" if terms else "-"

    for docs, low, high in ((documents, 0.01, 0.2), (awkward.where("doc_id is null or doc_id <> 79"), 0.05, 0.5)):
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        df = Counter(t for _, text in rows for t in terms_of(text))
        band = {t for t, n in df.items() if max(1, low * len(rows)) <= n <= max(1, high * len(rows))}
        found = fingerprints.lexicon(docs, min_share=low, max_share=high)
        assert {h % 2**64 for h in found} == band and band

        def print_of(text):
            own = terms_of(text)
            out = [mark(own)]
            for k, level in enumerate(fingerprints.LEVELS):
                part = lambda t: t >> (fingerprints.LEVEL_BITS + 4 * k + 2) & (1 << level) - 1  # noqa: B023, E731
                out += [mark({t for t in own & band if part(t) == i}) for i in range(fingerprints.PARTS)]
            return ".".join(out)

        got = Counter((r.doc_id, r.fingerprint) for r in fingerprints.fingerprints(docs, found).collect())
        assert got == Counter((d, print_of(text)) for d, text in rows)
    pairs = spark.createDataFrame([(["a", "-", "b", "c"], ["a", "-", "x", "-"]), (["-"], ["-"]), (["a", "b"], ["a", "b"])], "a array<string>, b array<string>")
    assert [r.l for r in pairs.select(fingerprints.likeness(F.col("a"), F.col("b")).alias("l")).collect()] == [1 / 3, 0, 1]


@pytest.mark.parametrize("borders", [3, 4096])
def test_next_document_across_buckets(spark, monkeypatch, borders):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    monkeypatch.setattr(fingerprints, "MAX_BORDERS", borders)
    rows = [(d * d - 500, f"t{d:03d}") for d in range(60)] + [(None, f"n{d:03d}") for d in range(20)] + [(4, "s000"), (4, "s001")]
    found = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len({r.bucket for r in found}) > 5
    ordered = [t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    assert {r.text: r.next_text for r in found} == dict(zip(ordered, ordered[1:] + ordered[:1]))


PAGES = "page_id long, url string, html string, record string"


def warc_expected(rows, least):
    rank = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    first, out = {}, Counter()
    for r in sorted(rows, key=rank):
        page, _, html, _ = r
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        revisit = len(body) >= least and digest in first
        out[page, len(body), digest, "revisit" if revisit else "response", first[digest] if revisit else None] += 1
        if len(body) >= least:
            first.setdefault(digest, page)
    return out


@pytest.mark.parametrize("least", [0, 4])
def test_warc(spark, least):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>", "r"), (2, None, "<p>é</p>", "r"), (3, "u", "", None), (4, "u", None, None), (5, "u", "abc", None), (6, "u", "abc", None), (None, "u", "abc", None), (None, "v", "alone", None), (None, "v", "alone", None), (7, "u", "x\r\n\r\nWARC/1.1\r\n\r\n" * 60_000, None), (7, "u", "x\r\n\r\nWARC/1.1\r\n\r\n" * 60_000, None), (8, "u", "x\r\n\r\nWARC/1.1\r\n\r\n" * 60_000, None)]
    found = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(2), least).collect()
    assert Counter(map(tuple, found)) == warc_expected(rows, least)
    # every record has an id of its own, and a revisit names its response's
    squeezed = zstandard.ZstdDecompressor()
    heads = [squeezed.decompress(bytes(r.body)).decode() for r in warc.records(spark.createDataFrame(rows, PAGES), least).where("chunk = 0").collect()]
    ids = [re.search("WARC-Record-ID: (.*?)\r", h)[1] for h in heads]
    assert len(set(ids)) == len(ids) == len(rows)
    assert {m[1] for h in heads if (m := re.search("WARC-Refers-To: (.*?)\r", h))} <= {i for i, h in zip(ids, heads) if "WARC-Type: response" in h}


def test_warc_file(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    warc.write(pages, str(tmp_path / "w"))
    parser = warc.Parser()
    whole = b"".join(warc.stream(spark, str(tmp_path / "w")))
    found = [r for a in range(0, len(whole), 777) for r in parser.feed(whole[a : a + 777])]
    assert Counter(tuple(r.values()) for r in found) == warc_expected([(r.page_id, r.url, r.html, None) for r in pages.collect()], 0)
    assert warc.round_trip(pages.where("false")).count() == 0


def check_packing(rows, expected, capacity):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(awkward, documents, empty, library, capacity):
    for docs in (awkward, documents):
        expected, total = Counter(), 0
        for r in docs.collect():
            ids = [*library(r.text), 0]
            total += len(ids)
            for piece, a in enumerate(range(0, len(ids), capacity)):
                part = ids[a : a + capacity]
                expected[r.doc_id, piece, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        n = check_packing(packing.pack(docs, VOCABULARY, capacity, group_rows=50).collect(), expected, capacity)
        assert n <= 1 + 1.02 * total / capacity
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_plan_uses_every_length():
    r = np.random.default_rng(4)
    histogram = np.bincount(r.integers(1, 257, 20_000), minlength=257)
    used = np.zeros(257, np.int64)
    patterns = packing.plan(histogram, 256)
    for own, times in patterns:
        assert sum(own) <= 256
        for n in own:
            used[n] += times
    assert (used == histogram).all()
    assert sum(t for _, t in patterns) <= 1.01 * (histogram * np.arange(257)).sum() / 256


def test_decontamination(spark, awkward, empty):
    items = [(1, passage(50, 40)), (2, passage(51, 6)), (3, None), (4, ""), (5, passage(52, 15))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    changed = passage(50, 40).split()
    changed[11] = changed[25] = "other"
    docs = spark.createDataFrame(
        [(1, f"{passage(60, 30)} {items[0][1]}. {passage(61, 9)}"), (2, " ".join(changed)), (3, items[1][1].upper() + "!"), (4, passage(62, 500)), (5, " ".join(passage(50, 40).split()[:9])), (6, items[4][1]), (None, items[4][1]), (8, None)],
        "doc_id long, text string",
    )
    for block in (8 << 20, 60):
        found = {(r.doc_id, r.item_id): r for r in decontam.overlaps(docs, bench, block_chars=block).collect()}
        assert set(found) == {(1, 1), (2, 1), (3, 2), (6, 5), (None, 5)}
        assert (found[1, 1].first_word, found[1, 1].n_agreed, found[2, 1].n_agreed) == (30, 40, 38)
    assert decontam.overlaps(awkward, bench).count() == decontam.overlaps(empty, bench).count() == decontam.overlaps(docs, bench.where("false")).count() == 0


def test_decontamination_partial_and_edge_passages(spark):
    item = passage(50, 40).split()
    changed = item[:15]
    changed[4] = changed[9] = "other"
    before, after = passage(60, 30).split(), passage(61, 30).split()
    texts = {
        1: before + item[9:21] + after,  # a run of 12 in the middle
        2: before + item[10:29] + after,
        3: before + item[:20],  # cut by the end
        4: item[17:] + after,  # cut by the begin
        5: item[10:30],  # nothing but an excerpt
        6: before + item[:12],
        7: before + changed,  # 13 of 15 words
        8: before + item[9:20] + after,  # 11 words are too few
        9: before + item[:11],
        10: item[29:],
    }
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    found = {r.doc_id: r for r in decontam.overlaps(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6, 7}
    assert (found[3].first_word, found[3].n_compared, found[3].n_agreed) == (30, 20, 20)
    assert (found[4].first_word, found[4].n_compared, found[4].n_agreed) == (0, 23, 23)


def test_decontamination_null_item_id(spark):
    bench = spark.createDataFrame([(None, passage(50, 40)), (3, passage(51, 20)), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, passage(50, 40)), (2, passage(51, 20))], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench).collect()} == {(1, None), (2, 3)}


def test_seeds_find_every_substitution():
    """Each choice of changed words within the rule leaves a seed, by length; and short items are found against brute force."""
    for n in range(1, 25):
        changes = n - math.ceil(0.8 * n - 1e-9)
        places = [[t + j for j, c in enumerate(m) if c == "1"] for m in decontam.masks(n) for t in range(n - len(m) + 1)]
        for gone in itertools.combinations(range(n), changes):
            assert any(not set(gone) & set(p) for p in places), (n, gone)
    for n in (5, 8, 11, 12, 15, 16, 20):
        item, changes = passage(70 + n, n).split(), n - math.ceil(0.8 * n - 1e-9)
        gone = list(itertools.combinations(range(n), changes))[:3000]
        index = decontam.Index([(1, passage(190, 30)), (2, " ".join(item))])
        texts = [" ".join([*passage(191, 7).split(), *(f"{w}x" if i in g else w for i, w in enumerate(item)), "end"]) for g in gone]
        assert list(index.verified(decontam._Words(texts), 24, 0.8)) == [(k, 1, 7, n, n - changes) for k in range(len(gone))]


def test_decontamination_equals_brute_force():
    """Few different words, so that many diagonals agree in part."""
    r = random.Random(5)
    draw = lambda n: [r.choice("abcdefgh") for _ in range(n)]
    items = [draw(n) for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 18, 24, 40)]
    docs = [draw(r.randint(0, 60)) for _ in range(40)]
    for k in range(40):  # excerpts with substitutions
        item = r.choice(items)
        a = r.randrange(len(item))
        docs.append(draw(r.choice([0, 5])) + [w if r.random() < 0.85 else "z" for w in item[a : a + r.randint(1, 40)]] + draw(r.choice([0, 5])))
    expected = {}
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            for diagonal in range(-len(item) + 1, len(doc)):
                a, b = max(diagonal, 0), min(diagonal + len(item), len(doc))
                same = [doc[j] == item[j - diagonal] for j in range(a, b)]
                run, need = min(12, len(item)), min(24, len(same))
                if len(same) >= run and (any(sum(same[j : j + need]) >= 0.8 * need for j in range(len(same) - need + 1)) or any(all(same[j : j + run]) for j in range(len(same) - run + 1))):
                    expected[d, i] = max(expected.get((d, i), (-1,)), (sum(same), -a, b - a))
    index = decontam.Index([(k, " ".join(w)) for k, w in enumerate(items)])
    found = list(index.verified(decontam._Words([" ".join(w) for w in docs]), 24, 0.8))
    assert {(d, i): (n, -a, size) for d, i, a, size, n in found} == expected


def test_pipeline(spark, documents, library):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    (_, by_quality), (_, near), (_, cut), (_, clean), (_, pack) = corpus_pipeline.STAGES
    kept = by_quality(spark, documents, SMALL).persist()
    assert kept.schema == documents.schema
    bad = [i for i, q in labels.items() if q == 0]
    left = {r.doc_id for r in kept.collect()}
    assert sum(i in left for i in bad) <= 0.2 * len(bad)
    apart = near(spark, kept, SMALL).persist()
    texts = {r.doc_id: r.text for r in kept.collect()}
    groups = component_ids({d: shingles(t) for d, t in texts.items()})
    assert {r.doc_id for r in apart.collect()} == {d for d in texts if groups[d] == d or not shingles(texts[d])}
    shorter = cut(spark, apart, SMALL).persist()
    assert shorter.columns == documents.columns and shorter.count() == apart.count()
    expected = {}
    for d, s, g in removed(tuple, [(r.doc_id, r.text.encode().split()) for r in apart.collect()], 50):
        expected[d] = b" ".join(w for w, x in zip(s, g) if not x).decode() if any(g) else texts[d]
    assert {r.doc_id: r.text for r in shorter.collect()} == expected
    final = clean(spark, shorter, SMALL).persist()
    hit = {r.doc_id for r in decontam.overlaps(shorter, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in final.collect()} == set(expected) - hit
    packed = pack(spark, final, SMALL).collect()
    assert {r.doc_id for r in packed} == set(expected) - hit
    assert sum(r.length for r in packed) == sum(len(library(r.text)) + 1 for r in final.collect())


def test_pipeline_repeated_and_null_ids(spark):
    a, b, c, d = (passage(400 + k, 60) for k in range(4))
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (None, b), (3, c), (3, d), (3, d), (4, ""), (None, ""), (5, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (None, b), (3, c), (3, d), (4, ""), (None, ""), (5, None)])


def test_pipeline_stages_on_awkward_tables(spark, awkward, tmp_path):
    """Nulls, empty and long texts, repeated rows, empty tables, extra columns with clashing names: every stage has a defined result."""
    item = passage(700, 30)
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(d, 1, 0) for d in range(1, 60, 3)] + [(None, 1, 0), (61, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    clash = {c: F.lit(c) for c in ("mark", "n", "kept_text", "component_id", "kept_column_0", "column_0", "held_out", "length", "deal", "key1", "a", "b", "signature")}
    docs = awkward.unionByName(spark.createDataFrame([(200, f"x {item} y"), (None, f"{item} z"), (None, "clean " * 3)], "doc_id long, text string"), allowMissingColumns=True).withColumns(clash)
    for table in (docs, docs.where("false")):
        rows = table.count()
        quality_, near, cut, clean, pack = (f for _, f in corpus_pipeline.STAGES)
        scored = quality_(spark, table, str(tmp_path))
        assert scored.columns == table.columns and scored.count() <= rows
        apart = near(spark, table, str(tmp_path))
        assert apart.columns == table.columns
        shorter = cut(spark, table, str(tmp_path))
        assert shorter.columns == table.columns and shorter.count() == rows
        fair = clean(spark, table, str(tmp_path))
        assert fair.columns == table.columns
        if rows:
            kept = Counter((r.doc_id, r.text) for r in apart.collect())
            assert max(kept.values()) == 1 and (4, awkward_rows()[0][1]) not in kept and (None, None) in kept
            assert {(r.mark, r.kept_text, r.column_0, r.kept_column_0) for r in shorter.collect()} == {("mark", "kept_text", "column_0", "kept_column_0")}
            assert Counter((r.doc_id, r.text) for r in fair.collect()) == Counter((r.doc_id, r.text) for r in table.collect() if item not in (r.text or ""))
        placed = pack(spark, table, str(tmp_path))
        assert placed.where("piece = 0").count() == rows


def test_pipeline_cuts_rows_in_any_order(spark, awkward):
    """Texts and extra columns stay with their row when each reading has another order."""

    def moved(batches):
        table = pa.Table.from_batches(batches)
        yield from table.take(np.random.default_rng().permutation(table.num_rows)).to_batches()

    docs = awkward.withColumn("rank", F.concat_ws("|", F.col("doc_id").cast("string"), "text")).coalesce(1)
    rows = [(r.doc_id, r.rank, (r.text or "").encode().split(), r.text or "") for r in docs.collect()]
    expected = Counter()
    for (d, rank, _, text), (_, s, g) in zip(rows, removed(tuple, [(d, s) for d, _, s, _ in rows], 50)):
        expected[d, rank, b" ".join(w for w, x in zip(s, g) if not x).decode() if any(g) else text] += 1
    shorter = corpus_pipeline.cut_repeated_passages(spark, docs.mapInArrow(moved, docs.schema), SMALL)
    assert Counter((r.doc_id, r.rank, r.text) for r in shorter.collect()) == expected


@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_every_consumer(spark, name):
    """Counting, projecting and grouping a query's result work as collecting it does."""
    frame = corpus_pipeline.run(spark, SMALL) if name == "pipeline" else queries.QUERIES[name](spark, SMALL)
    rows = frame.collect()
    assert rows and frame.count() == len(rows)
    for c in frame.columns:
        assert Counter(r[0] for r in frame.select(c).collect()) == Counter(r[c] for r in rows)
    first, last = frame.columns[0], frame.columns[-1]
    assert {(r[0], r[1]): r[2] for r in frame.groupBy(first, last).count().collect()} == Counter((r[first], r[last]) for r in rows)


def test_rolling():
    r = np.random.default_rng(2)
    x = r.integers(0, 50, 300, dtype=np.uint64)
    for w in (1, 2, 3, 7, 43):
        assert rolling.sliding(x, w, np.minimum).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]
    y = np.tile(x[:40], 3)
    h = rolling.Prefix(y).every(10)
    assert (h[:30] == h[40:70]).all() and len(set(h[:30].tolist())) == 30


def test_oracles(spark):
    """The registered SQL gives the queries' rows."""
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        frame = queries.QUERIES[name](spark, SMALL)
        result = db.execute(sql)
        columns = [c[0] for c in result.description]
        order = [columns.index(c) for c in frame.columns]
        assert Counter(map(tuple, frame.collect())) == Counter(tuple(r[i] for i in order) for r in result.fetchall()), name
