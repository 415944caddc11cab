"""A knowledge base: ingest documents into a chunk table, and search it.

A base is an immutable value; every change gives a new one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators import chunking, ranking, store
from sieveline.operators.vectors import hash_embed

SHOWN = 500


@dataclass(frozen=True)
class Base:
    """``chunks``: id, source, text, vector, model, seq (order of insertion)."""

    chunks: DataFrame
    embed: Callable = hash_embed
    model: str = "hash"
    dims: int = 1024

    def ingest(self, docs: DataFrame, strategy: str = "markdown-code-aware", replace_source: bool = False, **options) -> Base:
        """With the chunks of ``docs`` (source, text), embedded; chunks with the id of an older one replace it.

        The new chunks go to the end, in order of source and place.  ``replace_source``
        also drops a source's older chunks of higher index.
        """
        cut = chunking.STRATEGIES[strategy](docs, **options).select("id", "source", "text", "index")
        vectors = self.embed(cut.select("id", "text"), self.dims)
        ordered = store.in_order(cut.join(vectors, "id"), "source", "index", "seq")
        new = ordered.select("id", "source", "text", "vector", F.lit(self.model).alias("model"), "seq")
        return replace(self, chunks=store.upsert_at_end(self.chunks, new, replace_source))

    def search(self, queries: DataFrame, k: int = 5, **options) -> DataFrame:
        """What the search tool shows of each hit: place, source, scores rounded, and the first 500 characters."""
        texts = self.chunks.select(F.col("id").alias("chunk_id"), "text")
        found = ranking.hybrid_search(texts, queries, k, dims=self.dims, embed=self.embed, **options)
        shown = self.chunks.select(F.col("id").alias("chunk_id"), "source", F.left("text", F.lit(SHOWN)).alias("excerpt"))
        return found.join(shown, "chunk_id").select("query_id", "rank", "chunk_id", "source", F.round("score", 3).alias("score"), "excerpt")

    def sources(self) -> DataFrame:
        return store.sources(self.chunks)

    def outdated(self) -> DataFrame:
        """(model, n) of chunks that another model embedded."""
        return store.model_mismatch(self.chunks, self.model)
