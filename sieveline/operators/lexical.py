"""Lexical ranking: postings, statistics and the two BM25 variants."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.tokenizers import memory_tokens, retrieval_tokens
from sieveline.operators import blocked


def statistics(chunks: DataFrame, tokens: Column) -> DataFrame:
    """(n, avgdl): number of chunks and their mean number of tokens, those without tokens included."""
    return chunks.select(F.size(tokens).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25(chunks: DataFrame, queries: DataFrame, tokenizer=retrieval_tokens, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, score) of the chunks that share a term with the query.

    ``chunks``: chunk_id, text; ``queries``: query_id, query.  A term's weight counts
    as often as the query has it; a null text counts as empty.  The postings are cut down to the queries' terms
    before anything is shuffled; if no chunk has a token, no row is returned.
    """
    asked = queries.select("query_id", F.explode(tokenizer(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    terms = asked.select("term").distinct()
    tokenized = chunks.select("chunk_id", tokenizer(F.coalesce("text", F.lit(""))).alias("tokens"))
    stats = tokenized.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    postings = (
        tokenized.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
        .join(terms, "term", "left_semi")
        .groupBy("chunk_id", "dl", "term")
        .agg(F.count("*").alias("tf"))
    )
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return (
        postings.join(df, "term")
        .join(asked, "term")
        .crossJoin(F.broadcast(stats))  # a single row
        .groupBy("query_id", "chunk_id")
        .agg(F.sum(weight * F.col("times")).alias("score"))
    )


def top_k(scored: DataFrame, k: int, by: str = "query_id", order: str = "chunk_id", score: str = "score") -> DataFrame:
    """The ``k`` best of each query with their rank; ties by ``order``.  Scores are compared to nine places."""
    best = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), order)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def best(chunks: DataFrame, queries: DataFrame, k: int, tokenizer=retrieval_tokens, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``top_k`` of ``bm25``, the ``k`` best chunks of each query that share a term with it.

    Queries with up to ``blocked.MOST_CELLS`` (query, term) cells: two passes over the
    chunks, one for the statistics, one that scores a block of chunks by a product
    with the queries' terms.  Beyond: postings are joined.
    """
    asked = blocked.terms_of(queries.select("query_id", tokenizer(F.col("query")).alias("tokens")))
    if asked is None:
        return top_k(bm25(chunks, queries, tokenizer, k1, b), k)
    tokenized = chunks.select("chunk_id", tokenizer(F.coalesce("text", F.lit(""))).alias("tokens"))
    rows = max(1, blocked.BLOCK_CELLS // max(len(asked.terms), 1))

    def count(batches):
        df, n, length = np.zeros(len(asked.terms), np.int64), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                tokens = batch.column("tokens").slice(at, rows)
                n, length = n + len(tokens), length + int(pc.sum(tokens.value_lengths()).as_py() or 0)
                df += (asked.matrix(tokens) > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(df))), pa.array(np.concatenate(([n, length], df)))], ["place", "n"])

    # two numbers, and one for each term of the queries
    sums = dict(tokenized.select("tokens").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect())
    n, avgdl = sums.get(-2, 0), (sums.get(-1, 0) / sums[-2] if sums.get(-2) else 0.0) or float("nan")
    df = np.array([sums.get(i, 0) for i in range(len(asked.terms))], float)
    weights = asked.counts * (np.log((n - df + 0.5) / (df + 0.5) + 1) * (k1 + 1) if n else df)

    def score(batch):
        tf, dl = asked.matrix(batch.column("tokens")), np.asarray(batch.column("tokens").value_lengths().fill_null(0))
        return weights @ (tf / (tf + (k1 * (1 - b + b * dl / avgdl))[:, None])).T

    return blocked.top_k(tokenized, asked.ids, dict(queries.dtypes)["query_id"], k, score, len(asked.terms), above=0.0)


def bm25_top_k(chunks: DataFrame, queries: DataFrame, k: int, keep_zero: bool = True) -> DataFrame:
    """The keyword list of each query: ``k`` best chunks, those that score 0 included (in order of chunk_id).

    With ``keep_zero`` only the ``k`` first chunks can fill up a list, so no pair of
    query and chunk beyond those is made.
    """
    scored = best(chunks, queries, k)
    if keep_zero:
        filler = chunks.select("chunk_id").orderBy("chunk_id").limit(k)  # k rows
        zero = queries.select("query_id").crossJoin(F.broadcast(filler)).withColumn("score", F.lit(0.0))
        scored = scored.drop("rank").unionByName(zero).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
        return top_k(scored, k)
    return scored


def memory_search(entries: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Memory entries by BM25 over name (three times), description (twice) and content; only positive scores.

    ``entries``: chunk_id, name, description, content.
    """
    document = F.concat_ws(" ", "name", "name", "name", "description", "description", "content")
    return best(entries.select("chunk_id", document.alias("text")), queries, k, memory_tokens, k1, b)
