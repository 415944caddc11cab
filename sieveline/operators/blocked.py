"""Ranking a table against a small set of queries in one pass: block products and local best lists.

The queries are a matrix on the driver, behind a check of its size (``fits``); each
Arrow batch is multiplied with it, each task keeps its own best rows of each query,
and only those are shuffled.  Callers have another plan for larger sets of queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers that a query matrix may have (32 MB), and those of a block of scores.
MOST_CELLS, BLOCK_CELLS = 4_000_000, 2_000_000


def fits(rows: int, columns: int) -> bool:
    """May a query matrix of this size live on the driver and in every task?"""
    return rows * max(columns, 1) <= MOST_CELLS


class Best:
    """The ``k`` best of each query so far: score to nine places, ties by id."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.scores: list[np.ndarray] = [np.zeros(0)] * n_queries
        self.ids: list[np.ndarray] = [np.zeros(0, object)] * n_queries

    def add(self, scores: np.ndarray, ids: np.ndarray, above: float = -np.inf) -> None:
        """``scores``: a row per query, a column per id.  Scores of ``above`` or less don't count."""
        rounded = np.round(scores, 9)
        for q, row in enumerate(rounded):
            # what the list's worst has, if it is full, must be reached
            bar = np.round(self.scores[q][-1], 9) if len(self.scores[q]) >= self.k else -np.inf
            keep = np.flatnonzero((row >= bar) & (scores[q] > above))
            if len(keep) > self.k:
                least = np.partition(row[keep], len(keep) - self.k)[len(keep) - self.k]
                keep = keep[row[keep] >= least]
            if not len(keep):
                continue
            all_scores, all_ids = np.concatenate((self.scores[q], scores[q][keep])), np.concatenate((self.ids[q], ids[keep]))
            order = np.lexsort((all_ids, -np.round(all_scores, 9)))[: self.k]
            self.scores[q], self.ids[q] = all_scores[order], all_ids[order]

    def batch(self, queries: pa.Array, kind: pa.DataType) -> pa.RecordBatch:
        sizes = [len(s) for s in self.scores]
        own = queries.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        ids = pa.array([x for ids in self.ids for x in ids.tolist()], kind)
        return pa.RecordBatch.from_arrays([own, ids, pa.array(np.concatenate([*self.scores, np.zeros(0)]))], ["query_id", "chunk_id", "score"])


def top_k(table: DataFrame, queries: pa.Array, query_type: str, k: int, scores: Callable[[pa.RecordBatch], np.ndarray], columns: int, above: float = -np.inf) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` best rows of ``table`` (chunk_id, ...) for each query.

    ``scores`` gives a row per query and a column per row of a batch; ``columns`` numbers
    per row bound the size of the batches that it gets.  Rows without an id are left out.
    """
    kind = dict(table.dtypes)["chunk_id"]
    rows = max(1, BLOCK_CELLS // max(columns, len(queries), 1))

    def best(batches: Iterator[pa.RecordBatch]):
        found, id_type = Best(len(queries), k), None
        for batch in batches:
            id_type = batch.schema.field("chunk_id").type
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found.add(scores(part), part.column("chunk_id").to_numpy(zero_copy_only=False), above)
        if id_type is not None:
            yield found.batch(queries, id_type)

    local = table.where("chunk_id is not null").mapInArrow(best, f"query_id {query_type}, chunk_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Terms:
    """The terms of a set of queries: a matrix of their counts, a row per query and a column per term."""

    def __init__(self, queries: pa.Table):
        """``queries``: query_id, tokens, and what else ``table`` shall have."""
        self.table = queries
        tokens = queries.column("tokens").combine_chunks()
        flat = tokens.flatten()
        self.ids = queries.column("query_id").combine_chunks()
        self.terms = flat.unique()
        lengths = np.asarray(tokens.value_lengths().fill_null(0))
        self.counts = np.zeros((len(tokens), len(self.terms)))
        np.add.at(self.counts, (np.repeat(np.arange(len(tokens)), lengths), np.asarray(flat.dictionary_encode().indices)), 1)

    def matrix(self, tokens: pa.Array) -> np.ndarray:
        """How often each of a batch's token lists has each term."""
        lengths = np.asarray(tokens.value_lengths().fill_null(0))
        place = pc.index_in(tokens.flatten(), value_set=self.terms)
        known = np.asarray(place.is_valid())
        cells = np.repeat(np.arange(len(tokens)), lengths)[known] * len(self.terms) + np.asarray(place.drop_null())
        return np.bincount(cells, minlength=len(tokens) * len(self.terms)).reshape(len(tokens), len(self.terms)).astype(float)


def terms_of(queries: DataFrame) -> Terms | None:
    """The terms of ``queries`` (query_id, tokens, ...), or None if they are too many for the driver."""
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("t")).first()
    if size.n * size.t > 4 * MOST_CELLS and not fits(size.n, queries.select(F.explode("tokens").alias("term")).distinct().count()):
        return None
    found = Terms(queries.toArrow())
    return found if fits(len(found.ids), len(found.terms)) else None
