"""The memory store: duplicates, eviction, lint, read and delete.

Entries: name, description, type, content, and times in milliseconds.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import extract_paths
from sieveline.functions.tokenizers import duplicate_tokens
from sieveline.operators import blocked

DUPLICATE, INDEX_SIZE, READ_LIMIT, DAY_MS = 0.34, 5, 4_000, 86_400_000
# Types of memory and the days they keep.
DAYS = {"user": 365, "feedback": 90, "project": 30, "reference": 14}
DEFAULT_DAYS = 30


def duplicates(candidates: DataFrame, entries: DataFrame, least: float = DUPLICATE, top: int = 3) -> DataFrame:
    """(candidate, name, score, rank): entries of the same type and another name with overlapping tokens.

    The overlap coefficient is taken over name and description; candidates without
    tokens find nothing.  Candidates with up to ``blocked.MOST_CELLS`` (candidate,
    token) cells and a name each are held against blocks of entries; beyond, tokens
    are joined by type and token.
    """
    tokens = lambda frame: frame.select("name", "type", duplicate_tokens(F.concat_ws(" ", "name", "description")).alias("tokens"))
    asked = blocked.terms_of(tokens(candidates).withColumnRenamed("name", "query_id"))
    if asked is not None and asked.ids.null_count == 0 and len(asked.ids.unique()) == len(asked.ids):
        kinds = asked.table.column("type").combine_chunks()
        known = kinds.unique()
        own = np.asarray(pc.index_in(kinds, value_set=known).fill_null(-1))
        sizes = asked.counts.sum(1)

        def score(batch):
            found = asked.counts @ asked.matrix(batch.column("tokens")).T
            found /= np.maximum(np.minimum.outer(sizes, np.asarray(batch.column("tokens").value_lengths())), 1)
            kind = np.asarray(pc.index_in(batch.column("type"), value_set=known, skip_nulls=True).fill_null(-2))
            found[(own[:, None] != kind) | (found < least)] = 0
            same = pc.index_in(batch.column("chunk_id"), value_set=asked.ids)
            found[np.asarray(same.drop_null()), np.flatnonzero(np.asarray(same.is_valid()))] = 0
            return found

        table = tokens(entries).withColumnRenamed("name", "chunk_id")
        found = blocked.top_k(table, asked.ids, dict(candidates.dtypes)["name"], top, score, len(asked.terms), above=0.0)
        return found.select(F.col("query_id").alias("candidate"), F.col("chunk_id").alias("name"), "score", "rank")
    a = tokens(candidates).select(F.col("name").alias("candidate"), "type", F.size("tokens").alias("na"), F.explode("tokens").alias("token"))
    b = tokens(entries).select("name", "type", F.size("tokens").alias("nb"), F.explode("tokens").alias("token"))
    both = a.join(b, ["type", "token"]).where("name <> candidate").groupBy("candidate", "name", "na", "nb").agg(F.count("*").alias("shared"))
    scored = both.withColumn("score", F.col("shared") / F.least("na", "nb")).where(F.col("score") >= least)
    best = Window.partitionBy("candidate").orderBy(F.round("score", 9).desc(), "name")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("candidate", "name", "score", "rank")


def lru(entries: DataFrame, keep: int = INDEX_SIZE, by: tuple[str, ...] = ()) -> DataFrame:
    """Entries with their place by last write, and whether they are evicted."""
    latest = Window.partitionBy(*by).orderBy(F.desc("last_write"), "name")
    return entries.withColumn("place", F.row_number().over(latest)).withColumn("evicted", F.col("place") > keep)


def lint(entries: DataFrame, known_paths: DataFrame, as_of: int) -> DataFrame:
    """(name, kind, detail) for stale paths, entries not read for longer than their type keeps, and repeated names.

    ``known_paths``: path.
    """
    paths = entries.select("name", F.explode(extract_paths(F.col("content"))).alias("path"))
    stale = paths.join(known_paths.distinct(), "path", "left_anti").select("name", F.lit("stale_path").alias("kind"), F.col("path").alias("detail"))
    keep = F.coalesce(F.create_map(*(F.lit(x) for kv in DAYS.items() for x in kv))[F.col("type")], F.lit(DEFAULT_DAYS))
    age = (F.lit(as_of) - F.col("last_read")) / DAY_MS
    unread = entries.where(age > keep).select("name", F.lit("never_used").alias("kind"), F.floor(age).cast("string").alias("detail"))
    times = entries.withColumn("times", F.count("*").over(Window.partitionBy("name"))).where("times > 1")
    repeated = times.select("name", F.lit("duplicate_name").alias("kind"), F.col("times").cast("string").alias("detail"))
    return stale.unionByName(unread).unionByName(repeated)


def read(entries: DataFrame, name: str, as_of: int, limit: int = READ_LIMIT) -> DataFrame:
    """An entry's content, cut to ``limit`` characters, with its new time of reading."""
    cut = F.when(F.length("content") > limit, F.concat(F.left("content", F.lit(limit)), F.lit("\n... (truncated)"))).otherwise(F.col("content"))
    return entries.where(F.col("name") == name).withColumn("content", cut).withColumn("last_read", F.lit(as_of))


def delete(entries: DataFrame, names: DataFrame) -> DataFrame:
    """Entries whose name isn't among ``names``."""
    return entries.join(names.select("name").distinct(), "name", "left_anti")


def save(entries: DataFrame, candidate: DataFrame, force: bool = False) -> DataFrame:
    """What saving each candidate comes to: update, duplicate or create."""
    known = candidate.join(entries.select("name", "type", F.lit(True).alias("exists")).distinct(), ["name", "type"], "left")
    twin = duplicates(candidate, entries).select(F.col("candidate").alias("name")).distinct().withColumn("twin", F.lit(not force))
    out = known.join(twin, "name", "left")
    return out.withColumn("action", F.when(F.col("exists"), "update").when(F.col("twin"), "duplicate").otherwise("create")).drop("exists", "twin")
