"""Token counts from the exact histogram of encoded lengths.

Documents are encoded once and counted by length; everything else is read from
suffix sums over the histogram: how many documents and tokens reach a length, and
how many tokens remain if each document is cut at a context limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm import encoding, shared

#: Lengths that one window of the suffix sums spans.
BLOCK = 4096


def lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens) of each row; null and empty texts have no token."""

    def count(tables):
        for table in tables:
            ids, texts = table.column("doc_id"), table.column("text").to_pylist()
            sizes = [encoding.encoder(vocabulary).flat(some, ids=False)[1] for _, some in encoding.batches(texts)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(sizes) if sizes else [], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_tokens long")


def histogram(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(n_tokens, n_docs): one row for each encoded length."""
    return lengths(docs, vocabulary).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length n of the histogram, taken as a context limit.

    docs_at_least and tokens_at_least count the documents of n tokens or more;
    truncated_total is the number of tokens that remain if all are cut at n;
    docs_share is the share of documents of n tokens at most (the quantile).
    Sums run within blocks of lengths, then over the blocks' totals.
    """
    rows = counts.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / block))
    totals = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # one row per block of lengths: as many as the longest document has blocks
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = totals.select("block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_beyond") for c in "dt"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    every = totals.agg(F.sum("d").alias("d_all"), F.sum("t").alias("t_all"))
    return (
        rows.withColumn("d", F.sum("n_docs").over(own))
        .withColumn("t", F.sum("tokens").over(own))
        .join(beyond, "block")
        .crossJoin(F.broadcast(every))  # a single row
        .select(
            "n_tokens",
            "n_docs",
            (F.col("d") + F.col("d_beyond")).alias("docs_at_least"),
            (F.col("t") + F.col("t_beyond")).alias("tokens_at_least"),
            (F.col("t_all") - (F.col("t") + F.col("t_beyond")) + F.col("n_tokens") * (F.col("d") + F.col("d_beyond"))).alias("truncated_total"),
            ((F.col("d_all") - F.col("d") - F.col("d_beyond") + F.col("n_docs")) / F.col("d_all")).alias("docs_share"),
        )
    )


def counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Histogram and suffix sums of all documents; an empty table gives no row.

    Null and empty texts have length 0; equal rows count each; only text and doc_id
    are read.  The histogram is written, as the sums read it more than once.
    """
    return suffix_sums(shared.written(histogram(docs, vocabulary), "histogram"))


def at_limits(counts_: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for any context limits, from the histogram rows alone."""
    spark = counts_.sparkSession
    asked = spark.createDataFrame([(int(n),) for n in limits], "context_limit long")
    return (
        asked.join(F.broadcast(counts_.select("n_tokens", "n_docs")), F.lit(True), "left")
        .groupBy("context_limit")
        .agg(
            F.sum("n_docs").alias("n_docs"),
            F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("truncated_total"),
            F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_cut"),
        )
    )
