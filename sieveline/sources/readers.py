"""Sources: text corpora, JSON-lines files, and note files with front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import trim_all
from sieveline.operators.memory import DAYS

GOLDEN = "id string, query string, source string, goldenAnswer string, tags array<string>, origin string"
SESSION = "type string, timestamp string, message struct<role:string,content:string>"


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of all .md and .txt files below ``path``; source is the path relative to it."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt,MD,TXT}").text(path, wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_path"), r"^\w+:/*", "/")
    return files.select(F.ltrim(F.replace(name, F.lit(path.rstrip("/")), F.lit("")), F.lit("/")).alias("source"), F.col("value").alias("text"))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden items; blank lines and // comments are skipped, a malformed line fails the query."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '//')")
    return lines.select(F.from_json("line", GOLDEN, {"mode": "FAILFAST"}).alias("item")).select("item.*")


def session(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a session log; malformed lines and other types are skipped.  Content that isn't text stays JSON."""
    parsed = spark.read.text(path).select(F.from_json("value", SESSION, {"mode": "PERMISSIVE"}).alias("row"))
    return parsed.where("row.type = 'message'").select("row.timestamp", "row.message.role", "row.message.content")


def front_matter(raw: Column) -> tuple[Column, Column, Column]:
    """(has front matter, map of its keys, trimmed body)."""
    pattern = r"(?s)^---\n(.*?)\n---\n(.*)$"
    lines = F.filter(F.split(F.regexp_extract(raw, pattern, 1), "\n"), lambda x: F.locate(":", x) > 1)
    pair = lambda x: F.struct(trim_all(F.substring_index(x, ":", 1)).alias("k"), trim_all(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("v"))
    keys = F.transform(lines, pair)
    # later keys win
    last = F.filter(keys, lambda p, i: ~F.exists(F.slice(keys, i + 2, F.size(keys)), lambda q: q["k"] == p["k"]))
    return raw.rlike(pattern), F.map_from_entries(last), trim_all(F.regexp_extract(raw, pattern, 2))


def memories(files: DataFrame) -> DataFrame:
    """Entries of note files (path, text); files without front matter, name or a known type are skipped."""
    ok, meta, body = front_matter(F.col("text"))
    rows = files.where(ok).select("path", meta.alias("meta"), body.alias("content"))
    return rows.where(F.col("meta")["name"] != "").where(F.col("meta")["type"].isin(*DAYS)).select(
        "path",
        F.col("meta")["name"].alias("name"),
        F.coalesce(F.col("meta")["description"], F.lit("")).alias("description"),
        F.col("meta")["type"].alias("type"),
        "content",
        F.expr("try_cast(meta['lastWriteAt'] as bigint)").alias("last_write"),
        F.expr("try_cast(meta['lastReadAt'] as bigint)").alias("last_read"),
    )


def skills(files: DataFrame) -> DataFrame:
    """(path, name, description, body) of skill files; front matter is optional, quoted values lose their quotes."""
    ok, meta, body = front_matter(F.col("text"))
    plain = lambda c: F.regexp_replace(c, "^([\"'])(.*)\\1$", "$2")
    folder = F.element_at(F.split("path", "/"), -2)
    rows = files.select("path", F.when(ok, meta).alias("meta"), F.when(ok, body).otherwise(F.col("text")).alias("body"), folder.alias("folder"))
    return rows.select("path", F.coalesce(plain(F.col("meta")["name"]), "folder").alias("name"), F.coalesce(plain(F.col("meta")["description"]), F.lit("")).alias("description"), "body")


def append_json(rows: DataFrame, path: str) -> None:
    """Append rows to a log, a JSON object per line."""
    rows.write.mode("append").json(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind) of what a folder holds: FILE, or DIR for the folders with files below them."""
    files = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(path).select(F.regexp_replace("path", r"^\w+:/*", "/").alias("path"))
    rest = F.ltrim(F.replace("path", F.lit(path.rstrip("/")), F.lit("")), F.lit("/"))
    return files.select(F.split(rest, "/").alias("p")).select(F.col("p")[0].alias("name"), F.when(F.size("p") > 1, "DIR").otherwise("FILE").alias("kind")).distinct()


def whole_file(spark: SparkSession, path: str) -> DataFrame:
    """(text): one row with a file's whole text."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
