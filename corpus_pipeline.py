"""A training corpus in stages; each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import decontam, ngram_join, packing, quality, shared, substring_dedup
from sieveline.llm.queries import vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Null and empty texts are scored as empty; repeated rows share their score; an
    empty table gives none; extra columns stay, whatever their names (in all stages).
    """
    return quality.accepted(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; sets without words stay.

    Of rows that repeat both id and text one stays; rows that share an id but not the
    text are one document for links.  A null id links nothing: of its rows only those
    with the text of another row go, be that an id's (if it has words) or a null one's.
    An empty table gives none.
    """
    others = ngram_join.join(docs).where("component_id <> doc_id").select("doc_id").distinct()
    # marks are small; without repeated rows, texts are dealt no second time
    mark = _free(docs, "mark")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    marks = marked.groupBy(mark).agg(F.count("*").alias("n"), F.count("doc_id").alias("named"), F.count_distinct("doc_id").alias("ids"))
    again = shared.written(marks.where("named > ids or (n > named and n > 1)").select(mark), "repeated")
    if again.limit(1).count():
        own = marked.join(again, mark, "left_semi").drop(mark).dropDuplicates(["doc_id", "text"])
        named = own.where("doc_id is not null").select("text").distinct().where(F.col("text").rlike("[^ \\t-\\r]"))
        own = own.where("doc_id is not null").unionByName(own.where("doc_id is null").join(named, "text", "left_anti").select(*docs.columns))
        docs = marked.join(again, mark, "left_anti").drop(mark).unionByName(own)
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the windows that a document with a smaller id has; the others' texts are unchanged.

    A null text becomes an empty one; null ids keep their text and cut nothing;
    n_chars, where it is a column, counts what is left.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {c: f"column_{i}" for i, c in enumerate(rest)}  # the operator's own columns have other names
    cut = substring_dedup.dedup(docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(k) for c, k in names.items())), keep=tuple(names.values()))
    cut = cut.select("doc_id", F.col("kept_text").alias("text"), *(F.col(k).alias(c) for c, k in names.items()))
    if "n_chars" in rest:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark.

    Rows that share an id go together; rows without an id are told by their texts.
    """
    bench = _table(spark, sf_dir, "benchmark")
    found = decontam.overlaps(docs, bench).where("doc_id is not null").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_anti").select(*docs.columns)
    if not docs.where("doc_id is null").limit(1).count():
        return kept
    mark = _free(docs, "mark")
    unnamed = docs.where("doc_id is null").withColumn(mark, F.xxhash64("text"))
    foul = decontam.overlaps(unnamed.select(F.col(mark).alias("doc_id"), "text"), bench).select(F.col("doc_id").alias(mark)).distinct()
    return kept.where("doc_id is not null").unionByName(unnamed.join(foul, mark, "left_anti").select(*docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of each piece of each document."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]
#: Training, hashing and packing have no form in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents; each stage's rows are written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
