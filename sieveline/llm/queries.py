"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import decontam, fingerprints, ngram_join, oracles, packing, quality, substring_dedup, suffix_dedup, token_counts, training_order, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The public vocabulary that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document after substring dedup of 50-word windows."""
    return substring_dedup.dedup(_table(spark, sf_dir, "documents")).drop("kept_text")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths with its suffix sums."""
    return token_counts.counts(_table(spark, sf_dir, "documents"), vocabulary())


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of the materialised training order, read back from its shards."""
    return training_order.round_trip(_table(spark, sf_dir, "documents"), vocabulary())


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document after byte-level dedup of 50-byte strings."""
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents")).drop("kept_text")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text."""
    return fingerprints.compare_edited(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as its archive has it."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of each document under the 5-gram Jaccard join."""
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each piece of each document."""
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that share a passage."""
    return decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_quality_classifier, op3_token_counts, op4_training_order, op5_suffix_dedup, op6_fingerprints, op7_warc, op8_ngram_join, op9_best_fit_packing, op10_decontamination)}
#: The others train, hash with functions that SQL lacks, or need the vocabulary.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op5_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op7_warc": oracles.WARC,
    "op8_ngram_join": oracles.NGRAM_JOIN,
}
