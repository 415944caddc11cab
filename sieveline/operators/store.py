"""Chunk stores and small lookups as immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: str, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with a column ``name``: 1, 2, ... in the order of ``order``, in ranges that are numbered in parallel.

    Ties are numbered in any order, nulls first.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.where(F.col(order).isNotNull()).select(order)
    cuts = sorted(set(some.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)] or [0.5])).first()[0] or []))  # at most ``parts`` numbers
    placed = rows.withColumn("_range", sum((F.when(F.col(order) > c, 1).otherwise(0) for c in cuts), F.lit(0)))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n")).collect()  # a row per range
    before, total = {}, 0
    for r in sorted(sizes):
        before[r["_range"]] = total
        total += r["_n"]
    start = F.create_map(*(F.lit(x) for kv in (before or {0: 0}).items() for x in kv))[F.col("_range")]
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return placed.withColumn(name, start + nth).drop("_range")


def in_order(rows: DataFrame, group: str, place: str, name: str) -> DataFrame:
    """``rows`` with a column ``name``: 0, 1, ... by ``group``, and by ``place`` (0, 1, ... or with gaps) within it.

    Rows are numbered within groups in parallel; only the groups' sizes are summed up,
    in ranges of groups.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    ranges = sizes.withColumn("_range", F.substring(F.col(group).cast("string"), 1, 2))
    totals = ranges.groupBy("_range").agg(F.sum("_n").alias("_t"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as groups have beginnings
    starts = totals.select("_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_range").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranges.join(starts, "_range").select(group, (F.col("_base") + F.coalesce(F.sum("_n").over(own), F.lit(0))).alias("_first"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(place)) - 1
    return rows.join(firsts, group).withColumn(name, F.col("_first") + nth).drop("_first")


def upsert_in_place(store: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those with the same id and keep their ``seq``; others follow at the end.

    ``new`` has its own order in ``seq``.
    """
    old = store.select("id", F.col("seq").alias("old_seq"))
    last = store.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    known = new.join(old, "id").withColumn("seq", F.col("old_seq")).select(*store.columns)
    fresh = numbered(new.join(old, "id", "left_anti"), "seq", "nth")
    placed = fresh.crossJoin(F.broadcast(last)).withColumn("seq", F.col("last") + F.col("nth")).select(*store.columns)
    return store.join(new.select("id"), "id", "left_anti").select(*store.columns).unionByName(known).unionByName(placed)


def upsert_at_end(store: DataFrame, new: DataFrame, replace_source: bool = False) -> DataFrame:
    """Rows of ``new`` go to the end, those with the same id go away.

    A source's older chunks of higher index stay unless ``replace_source``.
    """
    last = store.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"))
    kept = store.join(new.select("source").distinct(), "source", "left_anti") if replace_source else store.join(new.select("id"), "id", "left_anti")
    placed = new.crossJoin(F.broadcast(last)).withColumn("seq", F.col("last") + 1 + F.col("seq")).select(*store.columns)
    return kept.select(*store.columns).unionByName(placed)


def model_mismatch(store: DataFrame, model: str) -> DataFrame:
    """(model, n) of chunks that another model embedded."""
    return store.groupBy("model").agg(F.count("*").alias("n")).where(F.col("model") != model)


def sources(store: DataFrame) -> DataFrame:
    return store.select("source").distinct()


def where_equal(table: DataFrame, condition: str | None, limit: int = 10, order: str | None = None) -> DataFrame:
    """Rows where ``field=value`` holds (compared as text), at most ``limit``, with the total before the limit.

    Only what stands before the second ``=`` counts.  All columns are returned.
    """
    if condition:
        field, value = [*condition.split("="), ""][:2]
        table = table.where(F.col(field.strip()).cast("string") == value.strip())
    total = table.agg(F.count("*").alias("total"))
    rows = table.orderBy(order) if order else table
    return rows.limit(limit).crossJoin(F.broadcast(total))


def tool_lookup(tools: DataFrame, names: DataFrame) -> DataFrame:
    """Tools whose name is among comma-separated ``names`` (column: names), exactly."""
    asked = names.select(F.explode(F.split("names", ",")).alias("name")).select(F.trim("name").alias("name")).distinct()
    return tools.join(asked, "name", "left_semi")


def visible_tools(tools: DataFrame, discovered: DataFrame) -> DataFrame:
    """Tools that aren't deferred, or that have been discovered (name)."""
    return tools.where("not deferred").unionByName(tools.where("deferred").join(discovered.select("name").distinct(), "name", "left_semi"))


def grep(files: DataFrame, pattern: str, limit: int | None = 50) -> DataFrame:
    """(path, line, text): lines that match, whatever their case.  ``files``: path, text."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    found = lines.where(F.col("text").rlike(f"(?i){pattern}")).withColumn("text", F.rtrim("text"))
    return found.orderBy("path", "line").limit(limit) if limit else found


def table_list(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, columns, rows) of each table."""
    out = None
    for name, frame in tables.items():
        own = frame.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), F.lit(",".join(frame.columns)).alias("columns"), "rows")
        out = own if out is None else out.unionByName(own)
    return out


def select_text(table: str, condition: str | None = None, limit: int = 10) -> str:
    """The query that ``where_equal`` stands for, as text; values are quoted."""
    where = ""
    if condition:
        field, value = [*condition.split("="), ""][:2]
        where = " WHERE {} = '{}'".format(field.strip(), value.strip().replace("'", "''"))
    return f"SELECT * FROM {table}{where} LIMIT {limit}"


def schema_tokens(tools: DataFrame) -> DataFrame:
    """(deferred, tokens): a quarter of the characters of the tools' schemas, rounded up for each.  ``tools``: schema, deferred."""
    return tools.groupBy("deferred").agg(F.sum(F.ceil(F.length("schema") / 4)).cast("long").alias("tokens"))


def full_text_hits(hits: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits of each query (query_id, chunk_id, rank; lower is better) with their chunks' columns."""
    best = Window.partitionBy("query_id").orderBy("rank", "chunk_id")
    return hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).join(chunks, "chunk_id")
