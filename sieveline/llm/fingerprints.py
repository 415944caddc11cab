"""I-Match document fingerprints, with DataFrame functions alone.

Terms within a band of inverse document frequency form the lexicon.  A document's
distinct lexicon terms are sorted and hashed once for each of several randomised
subsets of the lexicon; two documents are alike in as many subsets as they have
the same terms in.  Subsets come in levels: each level keeps a quarter of the
share of the level before, so texts of any length have subsets with a few terms.

The lexicon is exact: a literal of the plan, dealt into slots by its hashes' low bits.
By the band's lower end it has at most (mean distinct terms of a document) /
min_share terms, whatever the number of documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The band: shares of all documents that a lexicon term stands in.
MIN_SHARE, MAX_SHARE = 0.002, 0.2
#: log2 of the number of lexicon parts at each level; sixteen parts of each are used.
LEVELS, PARTS = (4, 6, 8, 10, 12), 16
#: Bits of a term's hash that choose its part at the first level; each level has four more.
LEVEL_BITS = 20
#: Rows of a bucket of neighbours, and the most borders that a plan holds; between two borders ids are dealt evenly.
BUCKET_ROWS, MAX_BORDERS = 2_000, 4_096


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct terms (lower case, runs of letters and digits)."""
    terms = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, text: str = "text", min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> list[int]:
    """Hashes of the terms in the band.

    Document frequencies are exact and counted over all documents; only the terms in
    the band reach the driver.
    """
    n = docs.count()
    frequency = docs.select(F.explode(term_hashes(F.col(text))).alias("h")).groupBy("h").count()
    band = frequency.where(F.col("count").between(max(1, min_share * n), max(1, max_share * n)))
    return sorted(r.h for r in band.select("h").collect())


def _literal(numbers: list[int], kind: str = "array<bigint>") -> Column:
    """An array of numbers, folded into one literal of the plan."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(kind) if numbers else F.array().cast(kind)


def _slot(h: int, table: int, mask: int) -> int:
    """Where a term may stand in each of the two tables."""
    return (h >> 32 * table) & mask


def _tables(terms: list[int]) -> tuple[list[int], list[int], int]:
    """Two tables that hold every term, each in its own slot of one of them, and the mask of the slots (cuckoo hashing)."""
    mask = (2 << max(len(terms), 1).bit_length()) - 1
    while True:
        # an empty slot holds a number whose own slot is another one
        tables = [[0 if slot else 1 << 32 * k for slot in range(mask + 1)] for k in (0, 1)]
        free = [[True] * (mask + 1) for _ in (0, 1)]
        for h in terms:
            k = 0
            for _ in range(200):
                at = _slot(h, k, mask)
                tables[k][at], h = h, tables[k][at]
                if free[k][at]:
                    free[k][at] = False
                    break
                k = 1 - k
            else:
                break  # too many collisions: larger tables
        else:
            return tables[0], tables[1], mask
        mask = 2 * mask + 1


def parts(text: Column, terms: list[int]) -> Column:
    """The fingerprint's parts: of all terms, then of each subset of the lexicon ('-': no term of it)."""
    *tables, mask = _tables(terms)
    tables = [_literal(t) for t in tables]
    every = F.array_sort(term_hashes(text))

    def in_lexicon(h: Column) -> Column:
        places = [h, F.shiftrightunsigned(h, 32)]
        return (tables[0][places[0].bitwiseAND(mask).cast("int")] == h) | (tables[1][places[1].bitwiseAND(mask).cast("int")] == h)

    def mark(terms: Column) -> Column:
        return F.when(F.size(terms) == 0, "-").otherwise(F.lower(F.hex(F.xxhash64(terms).bitwiseAND(0xFFFFFFFF))))

    def of_level(band: Column, k: int) -> Column:
        shift, level = LEVEL_BITS + 4 * k + 2, LEVELS[k]

        def part(h: Column) -> Column:
            return F.shiftrightunsigned(h, shift).bitwiseAND((1 << level) - 1)

        # the terms of the level's used parts, then each part's
        own = F.array(F.filter(band, lambda h: part(h) < PARTS))
        numbers = F.sequence(F.lit(0), F.lit(PARTS - 1))
        return F.flatten(F.transform(own, lambda o: F.transform(numbers, lambda i: mark(F.filter(o, lambda h: part(h) == i)))))

    def subsets(terms: Column) -> Column:
        return F.concat(F.array(mark(terms["every"])), *(of_level(terms["band"], k) for k in range(len(LEVELS))))

    # one evaluation of the term list for all subsets
    once = F.transform(F.array(every), lambda e: F.struct(e.alias("every"), F.filter(e, in_lexicon).alias("band")))
    return F.transform(once, subsets)[0]


def likeness(a: Column, b: Column) -> Column:
    """Share of the parts that are the same, of those that are not empty in both."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == "-") & (y == "-"), 0).when(x == y, 1).otherwise(2))
    same = F.size(F.filter(pairs, lambda p: p == 1))
    return same / F.greatest(same + F.size(F.filter(pairs, lambda p: p == 2)), F.lit(1))


def fingerprints(docs: DataFrame, terms: list[int] | None = None) -> DataFrame:
    """(doc_id, fingerprint) of each row; null texts count as empty, extra columns are not read."""
    terms = lexicon(docs) if terms is None else terms
    return docs.select("doc_id", F.concat_ws(".", parts(F.coalesce("text", F.lit("")), terms)).alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """Each row with its bucket, its text, and the text of the next row in order of (doc_id, text); the first follows the last.

    Buckets are ranges of doc_id: between two quantiles, found by a binary search, ids
    are dealt evenly.  So the order is followed within buckets in parallel; only each
    bucket's first row crosses a border.  Rows without an id are dealt by the first
    bytes of their texts.
    """
    n = docs.count()
    count = max(1, math.ceil(n / BUCKET_ROWS))
    shares = min(MAX_BORDERS, count)
    each = math.ceil(count / shares)  # buckets between two borders
    found = docs.agg(F.percentile_approx("doc_id", [k / shares for k in range(shares + 1)])).first()[0]
    borders = sorted(set(found or [0]))
    held = _literal(borders)
    steps = [1 << k for k in reversed(range(max(len(borders) - 1, 1).bit_length()))]
    # how many borders are the id or less
    below = F.aggregate(_literal(steps, "array<int>"), F.lit(0), lambda at, step: F.when((at + step <= len(borders)) & (F.try_element_at(held, at + step) <= F.col("doc_id")), at + step).otherwise(at))
    low = F.coalesce(F.try_element_at(held, F.greatest(F.col("below"), F.lit(1))), F.lit(0))
    width = F.greatest(F.coalesce(F.try_element_at(held, F.col("below") + 1), F.lit(borders[-1] + 1)) - low, F.lit(1))
    within = F.least(F.floor((F.col("doc_id") - low) / width * each), F.lit(each - 1)).cast("long")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("below", below)
    unnamed = F.conv(F.hex(F.rpad(F.substring(F.encode("text", "UTF-8"), 1, 2), 2, F.lit(b"\x00"))), 16, 10).cast("long") - 65_536
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), unnamed).otherwise(F.when(F.col("below") == 0, 0).otherwise(F.col("below") * each + within))).drop("below")
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    placed = rows.select("*", F.lead("text").over(order).alias("following"), F.row_number().over(order).alias("nth"))
    placed = placed.withColumn("last", F.col("following").isNull())
    # one row per bucket
    across = Window.orderBy("bucket")
    firsts = placed.where("nth = 1").select("bucket", "text")
    firsts = firsts.select(
        "bucket",
        F.lit(True).alias("last"),
        F.coalesce(F.lead("text").over(across), F.first("text").over(across)).alias("first_beyond"),
    )
    return placed.join(firsts, ["bucket", "last"], "left").select("bucket", "doc_id", "text", "nth", F.coalesce("following", "first_beyond").alias("next_text"), "first_beyond")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and its edited form, whose second half is the next document's beginning.

    One row per input row; null and empty texts are empty (their fingerprint has no
    terms).  Rows are ordered by doc_id (null first), ties by text; repeated rows follow
    one another; an empty table gives no row; extra columns are not read, whatever
    their names.
    """
    terms = lexicon(docs)
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("left(next_text, cast(floor(length(text) / 2) as int))"))
    rows = with_next(docs).withColumn("edited", edited)
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    marked = rows.select(
        "bucket",
        "doc_id",
        "text",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        parts(F.col("text"), terms).alias("own"),
        parts(F.col("edited"), terms).alias("changed"),
        F.when(F.col("first_beyond").isNotNull(), parts(F.col("first_beyond"), terms)).alias("beyond"),
    )
    return marked.withColumn("following", F.coalesce(F.lead("own").over(order), F.col("beyond"))).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("own", ".").alias("fingerprint"),
        F.array_join("changed", ".").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
