"""Vector operators: hashed embeddings, the embedding cache, nearest neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.vectors import dot, l2_normalise
from sieveline.operators import blocked, lexical


def hash_vectors(texts: list, dims: int = 1024) -> np.ndarray:
    """A row for each text: character i adds its code at i mod dims, and 0.3 of it at (7 i + 13) mod dims; normalised.

    Null and empty texts give zeros.
    """
    out = np.zeros((len(texts), dims))
    for row, text in enumerate(texts):
        codes = np.frombuffer((text or "").encode("utf-32-le"), "<u4").astype(float)
        place = np.arange(len(codes))
        out[row] = np.bincount(place % dims, codes, dims) + np.bincount((7 * place + 13) % dims, 0.3 * codes, dims)
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(size == 0, 1, size)


def hash_embed(texts: DataFrame, dims: int = 1024) -> DataFrame:
    """(id, vector) by ``hash_vectors``.  ``texts``: id, text."""

    def embed(batches):
        for batch in batches:
            out = hash_vectors(batch.column("text").to_pylist(), dims)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dims), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), vectors], ["id", "vector"])

    return texts.select("id", "text").mapInArrow(embed, f"id {dict(texts.dtypes)['id']}, vector array<double>")


#: The same for a list of texts; ``text_top_k`` embeds within its own pass where an embedder has it.
hash_embed.vectors = hash_vectors


def embed_cached(texts: DataFrame, embed=hash_embed, dims: int = 1024) -> DataFrame:
    """Each distinct text is embedded once, whatever number of rows has it."""
    keyed = texts.withColumn("key", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))
    once = keyed.groupBy("key").agg(F.first("text").alias("text")).withColumnRenamed("key", "id")
    return keyed.select("id", "key").join(embed(once, dims).withColumnRenamed("id", "key"), "key").select("id", "vector")


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Lists as rows of ``dims`` doubles: longer ones are cut, shorter ones filled with zeros."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    flat = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(0))
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row[place < dims], place[place < dims]] = flat[place < dims]
    return out


def _asked(queries: DataFrame) -> tuple[pa.Array, np.ndarray] | None:
    """Ids and matrix of the queries, or None if they are too many for the driver."""
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dims")).first()
    if not blocked.fits(size.n, size.dims):
        return None
    rows = queries.select("query_id", "vector").toArrow().combine_chunks()
    return rows.column("query_id").combine_chunks(), _matrix(rows.column("vector").combine_chunks(), size.dims)


def _unit(vectors: pa.Array, dims: int) -> np.ndarray:
    """``_matrix`` of the lists divided by their norms (of their whole length), where those aren't zero."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    flat = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(0))
    size = np.sqrt(np.bincount(np.repeat(np.arange(len(lengths)), lengths), flat * flat, len(lengths)))
    return _matrix(vectors, dims) / np.where(size == 0, 1, size)[:, None]


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest chunks of each query: every query against every vector.

    ``vectors``: chunk_id, vector; ``queries``: query_id, vector.  Queries up to
    ``blocked.MOST_CELLS`` numbers are multiplied with each batch of vectors; beyond,
    pairs are rows.
    """
    if asked := _asked(queries):
        ids, matrix = asked
        unit = matrix / np.maximum(np.sqrt((matrix * matrix).sum(1, keepdims=True)), 1e-300)
        score = lambda batch: unit @ _unit(batch.column("vector"), unit.shape[1]).T
        return blocked.top_k(vectors.select("chunk_id", "vector"), ids, dict(queries.dtypes)["query_id"], k, score, unit.shape[1])
    unit = vectors.select("chunk_id", l2_normalise(F.col("vector")).alias("v"))
    asked = queries.select("query_id", l2_normalise(F.col("vector")).alias("q"))
    return lexical.top_k(unit.crossJoin(asked).select("query_id", "chunk_id", dot(F.col("q"), F.col("v")).alias("score")), k)


def knn_l2(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest by Euclidean distance; the score is 1 - distance.  Plans as for ``cosine_top_k``."""
    if asked := _asked(queries):
        ids, matrix = asked

        def score(batch):
            rows = _matrix(batch.column("vector"), matrix.shape[1])
            return np.array([1 - np.sqrt(((rows - q) ** 2).sum(1)) for q in matrix])

        return blocked.top_k(vectors.select("chunk_id", "vector"), ids, dict(queries.dtypes)["query_id"], k, score, matrix.shape[1])
    pairs = vectors.crossJoin(queries.withColumnRenamed("vector", "q"))
    gap = F.zip_with("vector", "q", lambda x, y: x.cast("double") - y.cast("double"))
    return lexical.top_k(pairs.select("query_id", "chunk_id", (1 - F.sqrt(dot(gap, gap))).alias("score")), k)


def text_top_k(chunks: DataFrame, queries: DataFrame, k: int, embed=hash_embed, dims: int = 1024) -> DataFrame:
    """``cosine_top_k`` of texts.  ``chunks``: chunk_id, text; ``queries``: query_id, query.

    An embedder with ``vectors`` runs in the pass that ranks, so no vector is moved.
    """
    rows = getattr(embed, "vectors", None)
    if rows is not None and blocked.fits(queries.count(), dims):
        asked = queries.select("query_id", "query").toArrow().combine_chunks()
        matrix = rows(asked.column("query").to_pylist(), dims)
        unit = matrix / np.maximum(np.sqrt((matrix * matrix).sum(1, keepdims=True)), 1e-300)
        score = lambda batch: unit @ rows(batch.column("text").to_pylist(), dims).T
        return blocked.top_k(chunks.select("chunk_id", "text"), asked.column("query_id").combine_chunks(), dict(queries.dtypes)["query_id"], k, score, dims)
    vectors = embed(chunks.select(F.col("chunk_id").alias("id"), "text"), dims).withColumnRenamed("id", "chunk_id")
    own = embed(queries.select(F.col("query_id").alias("id"), F.col("query").alias("text")), dims).withColumnRenamed("id", "query_id")
    return cosine_top_k(vectors, own, k)
