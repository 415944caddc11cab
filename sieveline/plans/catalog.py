"""The registered queries of the library's operators, with their DuckDB SQL.

Every query runs over its whole tables.  Relations stand in as follows: documents
are chunks and corpus, benchmark items are queries and golden answers, embeddings
and their label means are vectors and queries, conversations are message logs
(assistant turns as tool results), events are call and usage logs.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.functions import text as tx
from sieveline.functions import tokenizers as tok
from sieveline.functions import vectors as vec
from sieveline.operators import calls, chunking, context, evaluation, knowledge, lexical, memory, ranking, store, usage, vectors
from sieveline.sources import readers, scratch
from sieveline.streaming import logs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (tables) under its name, with its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register


def _r(c, places: int = 6):
    return F.round(c, places)


# ---- shared pieces of SQL

_CJK = r"\x{4e00}-\x{9fff}"


def _pairs(low: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({low}, '[{_CJK}]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))"


def t1(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace(lower({x}), '[^\w{_CJK}]+', ' ', 'g'), ' '), lambda t: length(t) > 1)"


def t2(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[a-z0-9_]+|[\x{{4e00}}-\x{{9fa5}}]')"


def t3(x: str) -> str:
    return f"list_distinct(list_concat(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda t: length(t) >= 2), {_pairs(f'lower({x})')}))"


def t4(x: str) -> str:
    return f"list_distinct(list_concat(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 1), {_pairs(f'lower({x})')}))"


def _counted(tokens: str) -> str:
    return f"SELECT term, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs FROM (SELECT doc_id, unnest({tokens}) AS term FROM documents) GROUP BY term"


def _bm25(docs: str, tokens, k1: float, b: float) -> str:
    """CTEs ``scored`` (query_id, chunk_id, score) over ``docs`` (chunk_id, text) and the benchmark."""
    return f"""tk AS (SELECT chunk_id, {tokens('text')} AS ts FROM ({docs})),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avgdl FROM tk),
po AS (SELECT chunk_id, len(ts) AS dl, term, count(*) AS tf FROM (SELECT chunk_id, ts, unnest(ts) AS term FROM tk) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
qt AS (SELECT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark),
scored AS (SELECT query_id, chunk_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS score
 FROM (SELECT query_id, chunk_id, tf, dl, term FROM (SELECT chunk_id, dl, term, tf FROM po GROUP BY ALL) JOIN qt USING (term)) JOIN df USING (term), st GROUP BY query_id, chunk_id)"""


_DOCS = "SELECT doc_id AS chunk_id, text FROM documents"


def _top(k: int, source: str = "scored") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {source} QUALIFY rank <= {k}"


def _chunks(t):
    return t("documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _asked(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("text").alias("answer"))


# ---- tokenizers


def _terms(t, tokens):
    return t("documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@query(_counted(t1("text")))
def tok_retrieval(t):
    return _terms(t, tok.retrieval_tokens)


@query(_counted(t2("text")))
def tok_memory(t):
    return _terms(t, tok.memory_tokens)


@query(_counted(t3("text")))
def tok_duplicate(t):
    return _terms(t, tok.duplicate_tokens)


@query(_counted(t4("text")))
def tok_matching(t):
    return _terms(t, tok.matching_tokens)


def _estimate(x: str, cjk, asc, other) -> str:
    na = rf"length(regexp_replace({x}, '[^\x00-\x7f]', '', 'g'))"
    nc = rf"length(regexp_replace({x}, '[^\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}\x{{3000}}-\x{{303f}}\x{{ff00}}-\x{{ffef}}\x{{20000}}-\x{{2a6df}}]', '', 'g'))"
    dec = lambda v: f"{v}::DECIMAL(10,4)"
    return f"ceil({nc} * {dec(cjk)} + {na} * {dec(asc)} + (length({x}) - {na} - {nc}) * {dec(other)})::BIGINT"


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_estimate('text', 0.6, 0.3, 0.5)} ELSE {_estimate('text', 1.5, 0.27, 0.5)} END AS tokens FROM documents")
def token_estimate(t):
    rows = t("documents").withColumn("model", F.when(F.col("doc_id") % 2 == 0, "no-such-model").otherwise("gpt-5"))
    return usage.with_model(rows).select("doc_id", usage.text_tokens(F.col("text")).alias("tokens"))


# ---- lexical


@query(f"WITH {_bm25(_DOCS, t1, 1.2, 0.75)} SELECT query_id, chunk_id, rank::INT AS rank, round(score, 6) AS score FROM ({_top(5)})")
def bm25_topk(t):
    """The five best documents of each benchmark item by BM25."""
    return lexical.best(_chunks(t), _asked(t), 5).select("query_id", "chunk_id", "rank", _r("score").alias("score"))


@query(f"WITH {_bm25(_DOCS, t1, 1.2, 0.75)}, allq AS (SELECT item_id AS query_id, chunk_id, coalesce(score, 0) AS score FROM benchmark CROSS JOIN ({_DOCS}) d LEFT JOIN scored ON scored.query_id = item_id AND scored.chunk_id = d.chunk_id) SELECT query_id, chunk_id, rank::INT AS rank, round(score, 6) AS score FROM ({_top(20, 'allq').replace('SELECT *', 'SELECT query_id, chunk_id, score')})".replace("SELECT item_id AS query_id, chunk_id, coalesce", "SELECT item_id AS query_id, d.chunk_id, coalesce"))
def bm25_keep_zero(t):
    """The keyword list of each item, chunks that score 0 included."""
    return lexical.bm25_top_k(_chunks(t), _asked(t), 20).select("query_id", "chunk_id", "rank", _r("score").alias("score"))


_MEMO = "SELECT doc_id AS chunk_id, concat_ws(' ', source, source, source, lang, lang, text) AS text FROM documents"


@query(f"WITH {_bm25(_MEMO, t2, 1.5, 0.75)}, pos AS (SELECT * FROM scored WHERE score > 0) SELECT query_id, chunk_id, rank::INT AS rank, round(score, 6) AS score FROM ({_top(5, 'pos')})")
def memory_bm25(t):
    entries = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("name"), F.col("lang").alias("description"), F.col("text").alias("content"))
    return lexical.memory_search(entries, _asked(t)).select("query_id", "chunk_id", "rank", _r("score").alias("score"))


# ---- vectors


@query("SELECT vec_id, dim - 1 AS dim, round(v / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS value FROM (SELECT vec_id, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings)")
def l2_normalise(t):
    return t("embeddings").select("vec_id", F.posexplode(vec.l2_normalise(F.col("embedding"))).alias("dim", "value")).select("vec_id", F.col("dim").cast("long").alias("dim"), _r("value").alias("value"))


@query("SELECT vec_id, dim - 1 AS dim, round(v / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS value FROM (SELECT vec_id, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n, unnest(e) AS v, generate_subscripts(e, 1) AS dim FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS e FROM embeddings))")
def truncate_normalise(t):
    return t("embeddings").select("vec_id", F.posexplode(vec.truncate_normalise(F.col("embedding"), 32)).alias("dim", "value")).select("vec_id", F.col("dim").cast("long").alias("dim"), _r("value").alias("value"))


_MEANS = "me AS (SELECT label AS query_id, list(m ORDER BY dim) AS q FROM (SELECT label, dim, avg(v) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY label, dim) GROUP BY label)"
_COS = f"{_MEANS}, vs AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, me)"
_L2 = "ls AS (SELECT query_id, vec_id AS chunk_id, 1 - list_distance(embedding::DOUBLE[], q) AS score FROM embeddings, me)"


def _means(t):
    """A query vector for each label: the mean of its vectors."""
    parts = t("embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda p: p["m"])
    return parts.groupBy(F.col("label").alias("query_id")).agg(ordered.alias("vector"))


def _vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


@query(f"WITH {_COS} SELECT query_id, chunk_id, rank::INT AS rank, round(score, 6) AS score FROM ({_top(10, 'vs')})")
def cosine_topk(t):
    return vectors.cosine_top_k(_vectors(t), _means(t), 10).select("query_id", "chunk_id", "rank", _r("score").alias("score"))


@query(f"WITH {_MEANS}, {_L2} SELECT query_id, chunk_id, rank::INT AS rank, round(score, 6) AS score FROM ({_top(10, 'ls')})")
def knn_l2(t):
    return vectors.knn_l2(_vectors(t), _means(t), 10).select("query_id", "chunk_id", "rank", _r("score").alias("score"))


_HASHED = """WITH ch AS (SELECT doc_id, unicode(unnest(string_split(text, '')))::DOUBLE AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM documents WHERE text <> ''),
co AS (SELECT doc_id, i % 64 AS dim, c FROM ch UNION ALL SELECT doc_id, (7 * i + 13) % 64, 0.3 * c FROM ch),
su AS (SELECT doc_id, dim, sum(c) AS v FROM co GROUP BY ALL), no AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM su GROUP BY doc_id)
SELECT doc_id, dim::BIGINT AS dim, round(v / n, 6) AS value FROM su JOIN no USING (doc_id) WHERE round(v / n, 6) <> 0"""


def _embedded(t, embed):
    out = embed(t("documents").select(F.col("doc_id").alias("id"), "text"), dims=64)
    return out.select(F.col("id").alias("doc_id"), F.posexplode("vector").alias("dim", "value")).select("doc_id", F.col("dim").cast("long").alias("dim"), _r("value").alias("value")).where("value <> 0")


@query(_HASHED)
def hash_embed(t):
    return _embedded(t, vectors.hash_embed)


@query(_HASHED)
def embed_cached(t):
    """Vectors of all documents, each distinct text embedded once."""
    return _embedded(t, vectors.embed_cached)


@query("SELECT event_id, round(CASE WHEN value - 50 < 0 THEN (50 - value) / (1 + 50 - value) ELSE 1 / (1 + value - 50) END, 6) AS score FROM events")
def fts_score(t):
    return t("events").select("event_id", _r(vec.fts_score(F.col("value") - 50)).alias("score"))


# ---- ranking

_LISTS = f"{_COS}, {_L2}, v AS ({_top(20, 'vs')}), k AS ({_top(20, 'ls')})"
_FUSE_WEIGHTED = """vp AS (SELECT *, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END AS part FROM v WINDOW w AS (PARTITION BY query_id)),
fu AS (SELECT query_id, chunk_id, sum(v) AS vs, sum(w) AS ks, min(p) AS position, 0.7 * sum(v) + (1 - 0.7) * sum(w) AS score FROM (SELECT query_id, chunk_id, part AS v, 0.0 AS w, rank AS p FROM vp UNION ALL SELECT query_id, chunk_id, 0.0, 1 / (1 + exp(-score)), rank + 1000000000 FROM k) GROUP BY query_id, chunk_id),
ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, position, chunk_id) AS rank FROM fu)"""
_FUSE_RRF = """fu AS (SELECT query_id, chunk_id, sum(v) AS vs, sum(w) AS ks, min(p) AS position, sum(v) + sum(w) AS score FROM (SELECT query_id, chunk_id, 1.0 / (60 + rank) AS v, 0.0 AS w, rank AS p FROM v UNION ALL SELECT query_id, chunk_id, 0.0, 1.0 / (60 + rank), rank + 1000000000 FROM k) GROUP BY query_id, chunk_id),
ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, position, chunk_id) AS rank FROM fu)"""
_WEIGHTED, _RRF = f"{_LISTS}, {_FUSE_WEIGHTED}", f"{_LISTS}, {_FUSE_RRF}"
_FUSED = "SELECT query_id, chunk_id, rank::INT AS rank, round(score, 6) AS score, round(vs, 6) AS vector_score, round(ks, 6) AS keyword_score FROM ra"


def _lists(t):
    return vectors.cosine_top_k(_vectors(t), _means(t), 20), vectors.knn_l2(_vectors(t), _means(t), 20)


def _fused(rows):
    return ranking.ordered(rows).select("query_id", "chunk_id", "rank", _r("score").alias("score"), _r("vector_score").alias("vector_score"), _r("keyword_score").alias("keyword_score"))


@query(f"WITH {_WEIGHTED} {_FUSED}")
def fusion_weighted(t):
    return _fused(ranking.fuse_weighted(*_lists(t)))


@query(f"WITH {_RRF} {_FUSED}")
def fusion_rrf(t):
    return _fused(ranking.fuse_rrf(*_lists(t)))


def _reranked(blend: bool) -> str:
    new = "CASE WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.6 ELSE 0.4 END * s + (1 - CASE WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.6 ELSE 0.4 END) * p" if blend else "p"
    return f"""WITH {_WEIGHTED}, pr AS (SELECT *, (chunk_id * 37 % 101) / 100.0::DOUBLE AS p, rank > 20 AS tail, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END AS s FROM ra WINDOW w AS (PARTITION BY query_id, rank > 20)),
nw AS (SELECT query_id, chunk_id, rank AS old, tail, CASE WHEN tail THEN score ELSE {new} END AS score FROM pr)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY tail, CASE WHEN tail THEN old ELSE 0 END, round(score, 9) DESC, old)::INT AS rank, round(score, 6) AS score FROM nw"""


def _rerank(t, blend):
    ranked = ranking.ordered(ranking.fuse_weighted(*_lists(t))).withColumn("p", (F.col("chunk_id") * 37 % 101) / 100.0)
    return ranking.rerank(ranked, "p", blend).select("query_id", "chunk_id", "rank", _r("score").alias("score"))


@query(_reranked(True))
def rerank_blend(t):
    return _rerank(t, True)


@query(_reranked(False))
def rerank_pure(t):
    return _rerank(t, False)


@query(f"WITH s AS (SELECT item_id, list_distinct({t1('text')}) AS ts FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.ts, b.ts)) AS i, len(a.ts) + len(b.ts) AS n FROM s a JOIN s b ON a.item_id < b.item_id) SELECT a, b, round(i::DOUBLE / (n - i), 6) AS jaccard FROM p WHERE i > 0")
def jaccard_pairs(t):
    """Jaccard of all pairs of benchmark items that share a token, by a join on tokens."""
    sets = t("benchmark").select("item_id", F.array_distinct(tok.retrieval_tokens(F.col("text"))).alias("ts"))
    one = sets.select("item_id", F.size("ts").alias("n"), F.explode("ts").alias("token"))
    other = one.select(F.col("item_id").alias("b"), F.col("n").alias("m"), "token")
    both = one.join(other, "token").where("item_id < b").groupBy(F.col("item_id").alias("a"), "b", "n", "m").agg(F.count("*").alias("i"))
    return both.select("a", "b", _r(F.col("i") / (F.col("n") + F.col("m") - F.col("i"))).alias("jaccard"))


def _diverse(ranked: str, k: int = 5) -> str:
    """SQL of ``k`` steps of selection; ``ranked`` is SQL for query_id, chunk_id, score, rank and ts (a set)."""
    steps = [f"cd AS ({ranked})", "pj AS (SELECT a.query_id, a.chunk_id AS a, b.chunk_id AS b, coalesce(len(list_intersect(a.ts, b.ts))::DOUBLE / nullif(len(list_distinct(list_concat(a.ts, b.ts))), 0), 0) AS j FROM cd a JOIN cd b ON a.query_id = b.query_id)", "c1 AS (SELECT query_id, chunk_id, score, 1 AS rank FROM cd WHERE rank = 1)"]
    for n in range(2, k + 1):
        steps.append(f"""c{n} AS (SELECT * FROM c{n - 1} UNION ALL SELECT query_id, chunk_id, score, {n} FROM (
 SELECT cd.query_id, cd.chunk_id, cd.score, cd.rank AS old, round(0.7::DOUBLE * cd.score - 0.3::DOUBLE * max(j), 9) AS worth FROM cd JOIN c{n - 1} h ON h.query_id = cd.query_id JOIN pj ON pj.query_id = cd.query_id AND pj.a = cd.chunk_id AND pj.b = h.chunk_id
 WHERE (cd.query_id, cd.chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM c{n - 1}) GROUP BY cd.query_id, cd.chunk_id, cd.score, cd.rank) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY worth DESC, old) = 1)""")
    return ", ".join(steps) + f" SELECT query_id, chunk_id, rank::INT AS rank, round(score, 6) AS score FROM c{k}"


_KEYWORD = f"{_bm25(_DOCS, t1, 1.2, 0.75)}, allq AS (SELECT item_id AS query_id, d.chunk_id, coalesce(score, 0) AS score FROM benchmark CROSS JOIN ({_DOCS}) d LEFT JOIN scored ON scored.query_id = item_id AND scored.chunk_id = d.chunk_id), kw AS ({_top(20, 'allq').replace('SELECT *', 'SELECT query_id, chunk_id, score')})"
#: CTEs v and k (the lists of a hybrid search) over all documents and benchmark items.
_SEARCHED = f"""{_KEYWORD}, tx AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark),
lt AS (SELECT kind, id, unicode(unnest(string_split(text, '')))::DOUBLE AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM tx WHERE text <> ''),
su AS (SELECT kind, id, dim, sum(c) AS x FROM (SELECT kind, id, i % 1024 AS dim, c FROM lt UNION ALL SELECT kind, id, (7 * i + 13) % 1024, 0.3 * c FROM lt) GROUP BY ALL),
ve AS (SELECT tx.kind, tx.id, list(coalesce(x, 0) ORDER BY r.dim) AS e FROM tx CROSS JOIN (SELECT unnest(range(1024)) AS dim) r LEFT JOIN su ON su.kind = tx.kind AND su.id = tx.id AND su.dim = r.dim GROUP BY tx.kind, tx.id),
un AS (SELECT *, CASE WHEN list_inner_product(e, e) = 0 THEN 1 ELSE sqrt(list_inner_product(e, e)) END AS n FROM ve),
hs AS (SELECT q.id AS query_id, d.id AS chunk_id, list_inner_product(q.e, d.e) / (q.n * d.n) AS score FROM un q JOIN un d ON q.kind = 'q' AND d.kind = 'd'),
v AS ({_top(20, 'hs')}), k AS (SELECT * FROM kw)"""


def _found(rows):
    return rows.select("query_id", "chunk_id", "rank", _r("score").alias("score"))


@query(f"WITH {_KEYWORD}, {_diverse(f'SELECT query_id, chunk_id, score, rank, list_distinct({t1("text")}) AS ts FROM kw JOIN documents ON doc_id = chunk_id')}")
def mmr_select(t):
    """Five diverse documents of each item, from its twenty best."""
    ranked = lexical.bm25_top_k(_chunks(t), _asked(t), 20).join(_chunks(t), "chunk_id").withColumn("tokens", F.array_distinct(tok.retrieval_tokens(F.col("text"))))
    return _found(ranking.mmr(ranked, 5))


@query(f"WITH {_SEARCHED}, {_FUSE_WEIGHTED}, {_diverse(f'SELECT query_id, chunk_id, score, rank, list_distinct({t1("text")}) AS ts FROM ra JOIN documents ON doc_id = chunk_id')}")
def hybrid_search(t):
    """The flagship: five documents of each benchmark item, both lists fused and made diverse."""
    return _found(ranking.hybrid_search(_chunks(t), _asked(t).drop("answer")))


_SHARE = "CASE WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.6 ELSE 0.4 END::DOUBLE"


@query(f"""WITH {_SEARCHED}, {_FUSE_RRF}, pr AS (SELECT ra.*, rank > 20 AS tail, {t4("b.text")} AS qs, {t4("d.text")} AS ds, d.text FROM ra JOIN documents d ON doc_id = chunk_id JOIN benchmark b ON item_id = query_id),
bl AS (SELECT *, CASE WHEN len(qs) = 0 THEN 0 ELSE len(list_intersect(qs, ds))::DOUBLE / len(qs) END AS p, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END AS s FROM pr WINDOW w AS (PARTITION BY query_id, tail)),
nw AS (SELECT query_id, chunk_id, text, rank AS old, tail, CASE WHEN tail THEN score ELSE {_SHARE} * s + (1 - {_SHARE}) * p END AS score FROM bl),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tail, CASE WHEN tail THEN old ELSE 0 END, round(score, 9) DESC, old) AS rank FROM nw),
{_diverse(f'SELECT query_id, chunk_id, score, rank, list_distinct({t1("text")}) AS ts FROM rr')}""")
def hybrid_search_rrf_rerank(t):
    return _found(ranking.hybrid_search(_chunks(t), _asked(t).drop("answer"), fusion="rrf", reranking="blend"))


# ---- chunking


def _windows(width: int, step: int) -> str:
    last = "length(text)" if step == width else f"greatest(ceil((length(text) - {width}) / {step}.0)::BIGINT * {step}, 0) + 1"
    return f"""SELECT doc_id, text, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS index, s AS start_offset, least(s + {width}, n) AS end_offset
FROM (SELECT doc_id, s, n, substr(text, s + 1, {width}) AS text FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, {last}, {step})) AS s FROM documents WHERE text <> '')) WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''"""


_CHUNK_ROW = "SELECT doc_id::VARCHAR || '#' || index AS id, md5(text) AS text_md5, ceil(length(text) / 1.6::DOUBLE)::INT AS token_estimate, start_offset::INT AS start_offset, end_offset::INT AS end_offset"


def _sourced(t):
    return t("documents").select(F.col("doc_id").cast("string").alias("source"), "text")


def _chunk_rows(rows):
    return rows.select("id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "token_estimate", "start_offset", "end_offset")


@query(f"{_CHUNK_ROW} FROM ({_windows(819, 819)})")
def chunk_fixed(t):
    return _chunk_rows(chunking.fixed_size(_sourced(t)))


@query(f"{_CHUNK_ROW} FROM ({_windows(819, 768)})")
def chunk_overlap(t):
    return _chunk_rows(chunking.fixed_overlap(_sourced(t)))


# Parts of 300 characters without white space, each with a mark of its own, cut from a document.
def _part_sql(n: int, size: int = 300) -> str:
    return f"rpad('[{n}]' || substr(regexp_replace(text, '[^A-Za-z]+', '_', 'g'), {300 * n + 1}, {size - 3}), {size}, 'x')"


def _part(n: int, size: int = 300):
    flat = F.regexp_replace("text", "[^A-Za-z]+", "_")
    return F.rpad(F.concat(F.lit(f"[{n}]"), F.substring(flat, 300 * n + 1, size - 3)), size, "x")


def _expected(parts: str, whole: str, pieces: list[tuple[str, str, str]]) -> str:
    """SQL of the chunks of ``whole``: (prefix, body, what stands at its start) over the columns of ``parts``."""
    rows = ", ".join(f"{{'index': {i}, 'body': {prefix} || {body}, 'start': strpos(w, {at}) - 1, 'size': length({body})}}" for i, (prefix, body, at) in enumerate(pieces))
    return f"""SELECT doc_id::VARCHAR || '#' || x.index AS id, md5(x.body) AS text_md5, ceil(length(x.body) / 1.6::DOUBLE)::INT AS token_estimate, x.start::INT AS start_offset, least(x.start + x.size, length(w))::INT AS end_offset
FROM (SELECT doc_id, w, unnest([{rows}]) AS x FROM (SELECT *, {whole} AS w FROM ({parts})))"""


_PARTS = f"SELECT doc_id, lang, chr(10) AS n, {', '.join(f'{_part_sql(i)} AS p{i}' for i in range(7))}, {_part_sql(7, 90)} AS code, '数据' || lang || '检索引擎。' AS cjk FROM documents"


def _made(t, *pieces):
    """(source, text): the pieces, strings or columns, end to end."""
    return t("documents").select(F.col("doc_id").cast("string").alias("source"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in pieces)).alias("text"))


@query(_expected(_PARTS, "p0 || n || n || p1 || n || n || n || p2 || n || n || p3 || '。' || p4 || '. ' || p5 || '!' || n || n || 'end' || n", [("''", "p0 || n || n || p1", "p0"), ("''", "p2", "p2"), ("''", "p3 || '。 ' || p4 || '.'", "p3"), ("''", "p5 || '!' || n || n || 'end'", "p5")]))
def chunk_recursive(t):
    """Paragraphs that fit together, one alone, a long one by its sentences, and what is left of it with the next."""
    made = _made(t, _part(0), "\n\n", _part(1), "\n\n\n", _part(2), "\n\n", _part(3), "。", _part(4), ". ", _part(5), "!\n\nend\n")
    return _chunk_rows(chunking.STRATEGIES["recursive-paragraph"](made))


_MARKDOWN = "p0 || n || '#  One ' || n || n || p1 || n || n || p2 || n || n || p3 || n || '## Sub ' || lang || n || '  ```py' || n || '# no heading' || n || n || code || n || '```' || n || cjk || n || '# Two' || n || n || '### Deep' || n || p4 || n || '#none' || n || '# Three' || n || '```' || n || p5"
_BLOCK = "'```py' || n || '# no heading' || n || n || code || n || '```'"


def _markdown(t):
    return _made(t, _part(0), "\n#  One \n\n", _part(1), "\n\n", _part(2), "\n\n", _part(3), "\n## Sub ", F.col("lang"), "\n  ```py\n# no heading\n\n", _part(7, 90), "\n```\n数据", F.col("lang"), "检索引擎。\n# Two\n\n### Deep\n", _part(4), "\n#none\n# Three\n```\n", _part(5))


_HEAD = [("''", "p0", "p0"), ("'One' || n || n", "p1 || n || n || p2", "p1"), ("'One' || n || n", "p3", "p3")]
_SUB, _DEEP, _THREE = "'One > Sub ' || lang || n || n", ("'Two > Deep' || n || n", "p4 || n || '#none'", "p4"), ("'Three' || n || n", "'```' || n || p5", "'```' || n || p5")


@query(_expected(_PARTS, _MARKDOWN, [*_HEAD, (_SUB, f"{_BLOCK} || n || cjk", "'```py'"), _DEEP, _THREE]))
def chunk_markdown_section(t):
    """Headings of several depths, one within a fence, sections without a body, an open fence and CJK."""
    return _chunk_rows(chunking.STRATEGIES["markdown-section"](_markdown(t)))


@query(_expected(_PARTS, _MARKDOWN, [*_HEAD, (_SUB, f"'  ' || {_BLOCK}", "'  ```py'"), (_SUB, "cjk", "cjk"), _DEEP, _THREE]))
def chunk_markdown_code_aware(t):
    """The same text; fenced blocks are chunks of their own."""
    return _chunk_rows(chunking.STRATEGIES["markdown-code-aware"](_markdown(t)))


# ---- evaluation

_CONTAIN = f"""gt AS (SELECT item_id AS query_id, len(ts) AS n, unnest(ts) AS token FROM (SELECT item_id, {t4('text')} AS ts FROM benchmark)),
dt AS (SELECT doc_id AS chunk_id, unnest({t4('text')}) AS token FROM documents),
cn AS (SELECT query_id, chunk_id, count(*)::DOUBLE / n AS containment FROM gt JOIN dt USING (token) GROUP BY query_id, chunk_id, n),
rel AS (SELECT query_id, chunk_id FROM cn WHERE containment >= 0.7)"""


@query(f"WITH {_CONTAIN} SELECT query_id, chunk_id, round(containment, 6) AS containment FROM cn")
def containment(t):
    return evaluation.containment(_asked(t), _chunks(t)).select("query_id", "chunk_id", _r("containment").alias("containment"))


@query(f"WITH {_CONTAIN} SELECT item_id AS query_id, count(chunk_id)::BIGINT AS n_relevant FROM benchmark LEFT JOIN rel ON query_id = item_id GROUP BY item_id")
def count_relevant(t):
    return evaluation.count_relevant(_asked(t), _chunks(t))


@query(f"""WITH {_CONTAIN}, src AS (SELECT item_id AS query_id, {t4('text')} AS ts, min(chunk_id) AS doc_id FROM benchmark JOIN rel ON query_id = item_id GROUP BY item_id, text),
ch AS (SELECT doc_id, index, text, lead(text) OVER (PARTITION BY doc_id ORDER BY index) AS nx FROM ({_windows(102, 102)})),
sc AS (SELECT query_id, len(list_intersect(ts, {t4('ch.text')}))::DOUBLE / len(ts) AS one, CASE WHEN nx IS NOT NULL THEN len(list_intersect(ts, {t4('ch.text || nx')}))::DOUBLE / len(ts) END AS two FROM src JOIN ch USING (doc_id))
SELECT query_id, coalesce(max(one) < 0.7 AND max(two) >= 0.7, false) AS split FROM sc GROUP BY query_id""")
def answer_split(t):
    found = evaluation.hits(_asked(t), _chunks(t)).groupBy("query_id").agg(F.min("chunk_id").alias("source"))
    golden = scratch.written(_asked(t).join(found, "query_id").withColumn("source", F.col("source").cast("string")), "golden")
    return evaluation.answer_split(golden, chunking.fixed_size(_sourced(t), 64))


_METRIC = f"""{_bm25(_DOCS, t1, 1.2, 0.75)}, {_CONTAIN}, tp AS ({_top(5)}),
mk AS (SELECT tp.query_id, tp.rank, ceil(length(text) / 1.6::DOUBLE) AS tokens, CASE WHEN rel.chunk_id IS NULL THEN 0 ELSE 1 END AS rel FROM tp JOIN documents ON doc_id = tp.chunk_id LEFT JOIN rel ON rel.query_id = tp.query_id AND rel.chunk_id = tp.chunk_id),
tot AS (SELECT item_id AS query_id, count(chunk_id) AS g FROM benchmark LEFT JOIN rel ON query_id = item_id GROUP BY item_id),
ag AS (SELECT query_id, sum(rel) AS found, count(*) AS returned, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(rel / log2(rank + 1)) AS dcg, sum(tokens) AS tokens, sum(tokens * rel) AS useful FROM mk GROUP BY query_id),
qm AS (SELECT tot.query_id, CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate, CASE WHEN g > 0 THEN coalesce(found::DOUBLE / g, 0) ELSE 0 END AS recall, coalesce(found::DOUBLE / returned, 0) AS precision, coalesce(1.0::DOUBLE / first, 0) AS mrr,
 CASE WHEN least(g, coalesce(returned, 0)) > 0 THEN dcg / list_sum(list_transform(range(1, least(g, returned) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg, CASE WHEN useful > 0 THEN tokens / useful END AS context_efficiency FROM tot LEFT JOIN ag USING (query_id))"""
_ROUND5 = ", ".join(f"round({m}, 6) AS {m}" for m in (*evaluation.METRICS, "context_efficiency"))
_AVG5 = ", ".join(f"round(coalesce(avg({m}), 0), 6) AS {m}" for m in evaluation.METRICS) + ", round(avg(context_efficiency), 6) AS context_efficiency, count(*)::BIGINT AS n_queries"
_TAG = "CASE WHEN length(text) < 150 THEN 'factoid' WHEN length(text) < 300 THEN 'long-answer' ELSE 'multi-hop' END"


def _metrics(t):
    found = lexical.best(_chunks(t), _asked(t), 5).join(_chunks(t), "chunk_id").withColumn("token_estimate", F.ceil(F.length("text") / 1.6))
    return evaluation.query_metrics(found.select("query_id", "chunk_id", "rank", "token_estimate"), evaluation.hits(_asked(t), _chunks(t)), evaluation.count_relevant(_asked(t), _chunks(t)))


def _rounded(rows):
    return rows.withColumns({m: _r(m) for m in (*evaluation.METRICS, "context_efficiency")})


@query(f"WITH {_METRIC} SELECT query_id, {_ROUND5} FROM qm")
def query_metrics(t):
    return _rounded(_metrics(t))


@query(f"WITH {_METRIC} SELECT {_AVG5} FROM qm")
def macro_average(t):
    return _rounded(evaluation.macro_average(_metrics(t)))


@query(f"WITH {_METRIC} SELECT {_TAG} AS tag, {_AVG5} FROM qm JOIN benchmark ON item_id = query_id GROUP BY 1")
def per_tag_average(t):
    tags = t("benchmark").select(F.col("item_id").alias("query_id"), F.array(F.expr(_TAG)).alias("tags"))
    return _rounded(evaluation.per_tag(_metrics(t), tags))


@query()
def eval_matrix(t):
    """Five chunkers, two fusions, with and without reranking, over all documents and items."""
    tags = t("benchmark").select(F.col("item_id").alias("query_id"), F.array(F.expr(_TAG)).alias("tags"))
    golden = _asked(t).join(tags, "query_id").join(evaluation.hits(_asked(t), _chunks(t)).groupBy("query_id").agg(F.min("chunk_id").cast("string").alias("source")), "query_id", "left")
    return evaluation.matrix(_sourced(t), golden)


@query(f"""WITH {_CONTAIN}, src AS (SELECT item_id, min(chunk_id) AS s FROM benchmark LEFT JOIN rel ON query_id = item_id GROUP BY item_id),
it AS (SELECT CASE WHEN item_id % 9 = 0 THEN 'q0' ELSE 'q' || item_id END AS id, item_id, CASE WHEN item_id % 7 = 0 THEN ' ' ELSE text END AS query, CASE WHEN item_id % 5 = 0 THEN '' ELSE text END AS answer, CASE WHEN item_id % 4 = 0 THEN 'made-up' ELSE 'synth' END AS origin, CASE WHEN item_id % 6 = 0 THEN 'odd' ELSE {_TAG} END AS tag, CASE WHEN item_id % 3 = 0 THEN '0' ELSE s::VARCHAR END AS source FROM benchmark JOIN src USING (item_id)),
jo AS (SELECT it.*, d.text AS body, row_number() OVER (PARTITION BY id ORDER BY item_id) AS nth FROM it LEFT JOIN documents d ON d.doc_id::VARCHAR = it.source)
SELECT id, message, count(*)::BIGINT AS n FROM (SELECT id, 'id repeated' AS message FROM jo WHERE nth > 1 UNION ALL SELECT id, 'query empty' FROM jo WHERE trim(query) = '' UNION ALL SELECT id, 'answer empty' FROM jo WHERE trim(answer) = ''
UNION ALL SELECT id, 'origin not allowed' FROM jo WHERE origin = 'made-up' UNION ALL SELECT id, 'tag not allowed: odd' FROM jo WHERE tag = 'odd' UNION ALL SELECT id, 'source missing' FROM jo WHERE body IS NULL
UNION ALL SELECT id, 'answer not grounded' FROM jo WHERE body IS NOT NULL AND trim(answer) <> '' AND len(list_intersect({t4('answer')}, {t4('body')}))::DOUBLE / len({t4('answer')}) < 0.6) GROUP BY id, message""")
def validate_golden(t):
    """Faults of golden items made faulty on purpose, by kind."""
    src = evaluation.hits(_asked(t), _chunks(t)).groupBy("query_id").agg(F.min("chunk_id").cast("string").alias("s"))
    n = F.col("item_id")
    items = t("benchmark").join(src, n == F.col("query_id"), "left").select(
        F.when(n % 9 == 0, "q0").otherwise(F.concat(F.lit("q"), n.cast("string"))).alias("id"),
        F.when(n % 7 == 0, " ").otherwise(F.col("text")).alias("query"),
        F.when(n % 5 == 0, "").otherwise(F.col("text")).alias("answer"),
        F.when(n % 4 == 0, "made-up").otherwise("synth").alias("origin"),
        F.array(F.when(n % 6 == 0, "odd").otherwise(F.expr(_TAG))).alias("tags"),
        F.when(n % 3 == 0, "0").otherwise(F.col("s")).alias("source"),
        n.alias("seq"),
    )
    return evaluation.validate_golden(items, _sourced(t)).groupBy("id", "message").agg(F.count("*").alias("n"))


# ---- usage

_MODELS = ["gpt-5", "claude-haiku-4-5", "gemini-3-flash", "kimi-k2-6", "no-such-model"]
_PRICED = ", ".join(f"('{m}', {', '.join(map(str, usage.PRICES.get(m, usage.PRICES[usage.DEFAULT_MODEL])))})" for m in _MODELS)
_STEPS = f"""pr(model, pi, po, pw, prd) AS (VALUES {_PRICED}),
ra AS (SELECT event_id AS seq, user_id AS turn_id, ['{"', '".join(_MODELS)}'][user_id % 5 + 1] AS model, 1000 + floor(value)::BIGINT * 3 AS input_tokens, floor(value)::BIGINT AS output_tokens, CASE WHEN event_id % 3 = 0 THEN 200 WHEN event_id % 3 = 1 THEN 5000 END AS cached, event_id % 50 AS written FROM events),
st AS (SELECT *, CASE WHEN coalesce(cached, 0) <> 0 AND input_tokens >= cached THEN input_tokens - cached ELSE input_tokens END AS fresh_input, output_tokens AS output, coalesce(cached, 0) AS cache_read, written AS cache_write FROM ra),
co AS (SELECT *, (fresh_input * pi + output * po + cache_read * prd + cache_write * pw) / 1e6 AS cost, ((fresh_input + cache_read + cache_write) * pi + output * po) / 1e6 AS baseline FROM st JOIN pr USING (model))"""


def _steps(t):
    n = F.col("event_id")
    raw = t("events").select(
        n.alias("seq"),
        F.col("user_id").alias("turn_id"),
        F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("user_id") % 5 + 1).cast("int")).alias("model"),
        (F.floor("value") * 3 + 1000).cast("long").alias("input_tokens"),
        F.floor("value").cast("long").alias("output_tokens"),
        F.when(n % 3 == 0, 200).when(n % 3 == 1, 5000).cast("long").alias("cached_input_tokens"),
        F.lit(None).cast("long").alias("provider_cached_tokens"),
        (n % 50).cast("long").alias("cache_creation_tokens"),
        F.lit(None).cast("long").alias("provider_creation_tokens"),
    )
    return usage.normalise(raw)


@query(f"WITH {_STEPS} SELECT seq, model, fresh_input::BIGINT AS fresh_input, output, cache_read::BIGINT AS cache_read, cache_write::BIGINT AS cache_write, round(cost, 9) AS cost FROM co")
def usage_cost(t):
    return usage.cost(_steps(t)).select("seq", "model", "fresh_input", "output", "cache_read", "cache_write", _r("cost", 9).alias("cost"))


@query(f"WITH {_STEPS}, s AS (SELECT model, sum(fresh_input)::BIGINT AS fresh_input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write, sum(cost) AS c, sum(baseline) AS b, count(*)::BIGINT AS steps FROM co GROUP BY model) SELECT model, fresh_input, output, cache_read, cache_write, round(c, 6) AS cost, round(b, 6) AS baseline, steps, round(cache_read::DOUBLE / (fresh_input + cache_read + cache_write), 6) AS hit_rate, round(b - c, 6) AS saved FROM s")
def usage_totals(t):
    out = usage.totals(_steps(t), "model")
    return out.withColumns({c: _r(c) for c in ("cost", "baseline", "hit_rate", "saved")})


@query("SELECT event_id AS seq, value FROM events ORDER BY event_id DESC LIMIT 20")
def usage_recent(t):
    return usage.recent(t("events").select(F.col("event_id").alias("seq"), "value"), 20)


@query(f"SELECT model, 4000::BIGINT AS window_tokens, 3400::BIGINT AS trigger_tokens, 400::BIGINT AS floor_tokens FROM (SELECT DISTINCT ['{chr(39).join(_MODELS).replace(chr(39), chr(39) + ', ' + chr(39))}'][user_id % 5 + 1] AS model FROM events)")
def usage_thresholds(t):
    return usage.thresholds(_steps(t).select("model").distinct())


@query("WITH s AS (SELECT user_id AS turn_id, event_id AS seq, floor(value)::BIGINT * 20 AS tokens, sum(floor(value)::BIGINT * 20) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS used FROM events) SELECT turn_id, seq, used, used > 13500 AS warned, used > 15000 AND used - tokens <= 15000 AS stops FROM s")
def budget_stop(t):
    steps = t("events").select(F.col("user_id").alias("turn_id"), F.col("event_id").alias("seq"), (F.floor("value").cast("long") * 20).alias("tokens"))
    return usage.budget_stop(steps).select("turn_id", "seq", "used", "warned", "stops")


@query("""WITH l AS (SELECT conv_id, turn AS seq, CASE WHEN role = 'user' THEN length(text) * 2 END AS precise, length(text) AS chars FROM conversations),
i AS (SELECT *, count(precise) OVER (PARTITION BY conv_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM l),
c AS (SELECT conv_id, seq, (coalesce(max(precise) OVER w, 0) + ceil(sum(CASE WHEN precise IS NULL THEN chars ELSE 0 END) OVER w / 4.0))::BIGINT AS tokens FROM i WINDOW w AS (PARTITION BY conv_id, island ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT conv_id, seq, tokens, tokens >= 3000 AS alarm FROM c""")
def pending_estimate(t):
    log = t("conversations").select("conv_id", F.col("turn").alias("seq"), F.when(F.col("role") == "user", F.length("text") * 2).alias("precise"), F.length("text").alias("chars"))
    return usage.pending_estimate(log).select("conv_id", "seq", "tokens", "alarm")


# ---- context

_MSG = "ms AS (SELECT conv_id, turn AS idx, CASE WHEN role = 'assistant' THEN 'tool' ELSE role END AS role, 'search' AS tool, text, turn * 180000 AS ts FROM conversations)"


def _messages(t):
    return t("conversations").select("conv_id", F.col("turn").alias("idx"), F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"), F.lit("search").alias("tool"), "text", (F.col("turn") * 180000).alias("ts"), F.lit("mock-model").alias("model"))


@query(f"WITH {_MSG} SELECT conv_id, idx, role = 'tool' AND row_number() OVER (PARTITION BY conv_id, role ORDER BY idx DESC) > 1 AND length(text) >= 100 AS cleared FROM ms")
def microcompact(t):
    return context.microcompact(_messages(t), 1, 100).select("conv_id", "idx", "cleared")


_EST = _estimate("text", 0.6, 0.3, 0.5)


@query(f"""WITH {_MSG}, e AS (SELECT *, {_EST} AS tokens, length(text) AS n FROM ms), b AS (SELECT *, floor(25 * n / greatest(tokens, 1)) AS budget FROM e)
SELECT conv_id, idx, tokens, role = 'tool' AND tokens > 25 AS truncated, md5(CASE WHEN role = 'tool' AND tokens > 25 THEN left(text, floor(budget * 6 / 10)::INT) || chr(10) || chr(10) || '[truncated: ' || tokens || ' → ~25 tokens]' || chr(10) || chr(10) || right(text, floor(budget * 4 / 10)::INT) ELSE text END) AS text_md5 FROM b""")
def truncate_results(t):
    return context.truncate_results(_messages(t), 50).select("conv_id", "idx", "tokens", "truncated", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query(f"WITH {_MSG}, s AS (SELECT *, length(text) AS size FROM ms) SELECT conv_id, idx, role = 'tool' AND sum(size) OVER (PARTITION BY conv_id) - coalesce(sum(CASE WHEN role = 'tool' THEN size ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 400 AS compacted FROM s")
def budget_compact(t):
    return context.budget_compact(_messages(t).withColumn("size", F.length("text")), 400).select("conv_id", "idx", "compacted")


@query(f"""WITH {_MSG}, a AS (SELECT *, role = 'tool' AND NOT regexp_matches(text, '(?i)error|失败|不存在|denied|refused|timeout') AS ok, 1200000 - ts AS age FROM ms)
SELECT conv_id, idx, CASE WHEN ok AND age >= 600000 THEN 'hard' WHEN ok AND age >= 300000 AND length(text) > 100 THEN 'soft' ELSE 'keep' END AS action, length(CASE WHEN ok AND age >= 600000 THEN '[tool result expired: search]' WHEN ok AND age >= 300000 AND length(text) > 100 THEN left(text, 50) || chr(10) || chr(10) || '[soft pruned: ' || (length(text) - 100) || ' chars removed, content older than 5min]' || chr(10) || chr(10) || right(text, 50) ELSE text END)::BIGINT AS chars FROM a""")
def ttl_prune(t):
    return context.ttl_prune(_messages(t), 1_200_000, ends=50).select("conv_id", "idx", "action", F.length("text").cast("long").alias("chars"))


_TAKEN = "role = 'tool' AND NOT regexp_matches(x2, '(?i)error|失败|不存在|denied|refused|timeout')"


@query(f"""WITH {_MSG}, a AS (SELECT *, {_EST} AS tk, length(text) AS n FROM ms), b AS (SELECT *, floor(200 * n / greatest(tk, 1)) AS budget FROM a),
c AS (SELECT *, CASE WHEN role = 'tool' AND tk > 200 THEN left(text, floor(budget * 6 / 10)::INT) || chr(10) || chr(10) || '[truncated: ' || tk || ' → ~200 tokens]' || chr(10) || chr(10) || right(text, floor(budget * 4 / 10)::INT) ELSE text END AS x1 FROM b),
d AS (SELECT *, {_estimate('x1', 0.6, 0.3, 0.5)} AS size FROM c),
e AS (SELECT *, CASE WHEN role = 'tool' AND sum(size) OVER (PARTITION BY conv_id) - coalesce(sum(CASE WHEN role = 'tool' THEN size ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 300 THEN '[compacted: search output removed to free context]' ELSE x1 END AS x2 FROM d),
f AS (SELECT *, CASE WHEN {_TAKEN} AND 1200000 - ts >= 600000 THEN '[tool result expired: search]' WHEN {_TAKEN} AND 1200000 - ts >= 300000 AND length(x2) > 3000 THEN left(x2, 1500) || chr(10) || chr(10) || '[soft pruned: ' || (length(x2) - 3000) || ' chars removed, content older than 5min]' || chr(10) || chr(10) || right(x2, 1500) ELSE x2 END AS x3 FROM e)
SELECT conv_id, idx, {_estimate('x3', 0.6, 0.3, 0.5)} AS tokens, md5(x3) AS text_md5 FROM f""")
def context_defense(t):
    """Truncation, budget and age together."""
    return context.defend(_messages(t), 1_200_000, 400).select("conv_id", "idx", "tokens", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query(f"""WITH {_MSG}, e AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, 3 + {_EST} AS tk FROM ms), g AS (SELECT conv_id, max(n)::BIGINT AS n, sum(tk)::BIGINT AS tokens, coalesce(max(CASE WHEN role = 'user' AND idx <= n - 4 THEN idx END), 0) AS split_at FROM e GROUP BY conv_id)
SELECT conv_id, n, tokens, CASE WHEN tokens >= 40 AND n > 4 THEN split_at ELSE 0 END AS split_at, tokens > 340 AS compact FROM g""")
def summary_split(t):
    return context.summary_split(_messages(t), 4, 400)


@query("SELECT conv_id AS prompt_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS prompt_md5 FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def prompt_assembly(t):
    parts = t("conversations").select(F.col("conv_id").alias("prompt_id"), F.col("turn").alias("seq"), F.when(F.col("role") != "system", F.col("text")).alias("part"))
    return context.assemble(parts).where("prompt <> ''").select("prompt_id", F.md5(F.encode("prompt", "UTF-8")).alias("prompt_md5"))


@query("WITH s AS (SELECT conv_id, role AS category, sum(ceil(length(text) * 2 / 7.0)::BIGINT)::BIGINT AS tokens FROM conversations GROUP BY conv_id, role) SELECT conv_id, category, tokens, CASE WHEN tokens > 0 THEN greatest(1, floor(tokens * 256 / 4000.0 + 0.5)) ELSE 0 END::BIGINT AS cells, sum(tokens) OVER (PARTITION BY conv_id)::BIGINT AS used, 200::BIGINT AS buffer FROM s")
def context_snapshot(t):
    slices = t("conversations").select("conv_id", F.col("role").alias("category"), usage.rough_tokens(F.length("text")).alias("tokens"))
    return context.snapshot(slices, 4000)


# ---- memory


@query(f"""WITH e AS (SELECT 'doc ' || doc_id AS name, doc_id % 4 AS type, {t3("'doc ' || doc_id || ' ' || text")} AS ts FROM documents), c AS (SELECT 'item ' || item_id AS candidate, item_id % 4 AS type, {t3("'item ' || item_id || ' ' || text")} AS ts FROM benchmark),
a AS (SELECT candidate, type, len(ts) AS na, unnest(ts) AS token FROM c), b AS (SELECT name, type, len(ts) AS nb, unnest(ts) AS token FROM e),
o AS (SELECT candidate, name, count(*)::DOUBLE / least(na, nb) AS score FROM a JOIN b USING (type, token) GROUP BY candidate, name, na, nb)
SELECT candidate, name, round(score, 6) AS score, row_number() OVER (PARTITION BY candidate ORDER BY round(score, 9) DESC, name)::INT AS rank FROM o WHERE score >= 0.34 QUALIFY rank <= 3""")
def memory_duplicates(t):
    entries = t("documents").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), (F.col("doc_id") % 4).alias("type"), F.col("text").alias("description"))
    candidates = t("benchmark").select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"), (F.col("item_id") % 4).alias("type"), F.col("text").alias("description"))
    return memory.duplicates(candidates, entries).withColumn("score", _r("score"))


@query("SELECT user_id, event_id::VARCHAR AS name, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR)::INT AS place, place > 5 AS evicted FROM events")
def memory_lru(t):
    entries = t("events").select("user_id", F.col("event_id").cast("string").alias("name"), F.col("ts").alias("last_write"))
    return memory.lru(entries, by=("user_id",)).select("user_id", "name", "place", "evicted")


_NOTES = "no AS (SELECT 'note ' || (doc_id // 2) AS name, ['user', 'feedback', 'project', 'reference'][doc_id % 4 + 1] AS type, 'see src/' || lang || '/' || source || '.py, docs/' || lang || '.md!' AS content, doc_id * 86400000 AS last_read FROM documents)"


@query(rf"""WITH {_NOTES}, p AS (SELECT name, unnest(list_distinct(regexp_extract_all(content, '(?:^|[^\w/])([\w./-]+\.(?:{'|'.join(tx.PATH_EXTENSIONS)}))', 1))) AS path FROM no),
r AS (SELECT name, 'stale_path' AS kind, path AS detail FROM p WHERE path NOT IN (SELECT 'docs/' || lang || '.md' FROM documents)
UNION ALL SELECT name, 'never_used', floor((100000000000 - last_read) / 86400000.0)::BIGINT::VARCHAR FROM no WHERE (100000000000 - last_read) / 86400000.0 > CASE type WHEN 'user' THEN 365 WHEN 'feedback' THEN 90 WHEN 'project' THEN 30 ELSE 14 END
UNION ALL SELECT name, 'duplicate_name', n::VARCHAR FROM (SELECT name, count(*) OVER (PARTITION BY name) AS n FROM no) WHERE n > 1)
SELECT name, kind, detail, count(*)::BIGINT AS n FROM r GROUP BY ALL""")
def memory_lint(t):
    notes = t("documents").select(
        F.concat(F.lit("note "), F.floor(F.col("doc_id") / 2).cast("string")).alias("name"),
        F.element_at(F.array(*map(F.lit, memory.DAYS)), (F.col("doc_id") % 4 + 1).cast("int")).alias("type"),
        F.concat(F.lit("see src/"), "lang", F.lit("/"), "source", F.lit(".py, docs/"), "lang", F.lit(".md!")).alias("content"),
        (F.col("doc_id") * 86400000).alias("last_read"),
    )
    known = t("documents").select(F.concat(F.lit("docs/"), "lang", F.lit(".md")).alias("path")).distinct()
    return memory.lint(notes, known, 100_000_000_000).groupBy("name", "kind", "detail").agg(F.count("*").alias("n"))


@query("SELECT 'q' AS name, md5(CASE WHEN length(text) > 4000 THEN left(text, 4000) || chr(10) || '... (truncated)' ELSE text END) AS content_md5 FROM documents")
def memory_read(t):
    entries = t("documents").select(F.lit("q").alias("name"), F.col("text").alias("content"))
    return memory.read(entries, "q", 1).select("name", F.md5(F.encode("content", "UTF-8")).alias("content_md5"))


@query("SELECT doc_id::VARCHAR AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def memory_delete(t):
    return memory.delete(t("documents").select(F.col("doc_id").cast("string").alias("name")), t("labels").select(F.col("doc_id").cast("string").alias("name")))


# ---- loop detection

_CALLS = "ca AS (SELECT user_id AS turn_id, event_id AS seq, event_type AS tool, left(sha256(event_type || ':' || props), 16) AS args_hash, CASE WHEN event_id % 4 <> 0 THEN round(value / 50)::BIGINT::VARCHAR END AS result_hash FROM events)"


def _calls(t):
    return t("events").select(
        F.col("user_id").alias("turn_id"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("tool"),
        tx.short_hash(F.concat("event_type", F.lit(":"), "props")).alias("args_hash"),
        F.when(F.col("event_id") % 4 != 0, F.round(F.col("value") / 50).cast("long").cast("string")).alias("result_hash"),
    )


_DETECT = f"""WITH {_CALLS}, p AS (SELECT *, list_reverse(coalesce(list({{'t': tool, 'a': args_hash, 'r': result_hash}}) OVER (PARTITION BY turn_id ORDER BY seq ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), [])) AS past FROM ca),
s AS (SELECT *, list_filter(past, lambda c: c.t = tool AND c.a = args_hash) AS same, past[1].a AS last FROM p),
o AS (SELECT *, list_transform(list_filter(same, lambda c: c.r IS NOT NULL), lambda c: c.r) AS solved, list_filter(past, lambda c: c.a <> last)[1].a AS other FROM s),
c AS (SELECT *, len(same) AS repeats, CASE WHEN len(solved) = 0 THEN 0 ELSE coalesce(list_filter(range(len(solved)), lambda i: solved[i + 1] <> solved[1])[1], len(solved)) END AS streak, coalesce(list_filter(range(len(past)), lambda i: past[i + 1].a <> CASE WHEN i % 2 = 0 THEN last ELSE other END)[1], len(past)) AS run FROM o),
d AS (SELECT *, CASE WHEN other IS NOT NULL AND len(past) >= 3 AND args_hash = other AND run >= 2 THEN run + 1 ELSE 0 END AS ping_pong FROM c)
SELECT turn_id, seq, repeats::INT AS repeats, streak::INT AS streak, ping_pong::INT AS ping_pong, CASE WHEN streak >= 10 THEN 'critical:breaker' WHEN ping_pong >= 8 THEN 'critical:ping_pong' WHEN ping_pong >= 5 THEN 'warning:ping_pong' WHEN repeats >= 8 THEN 'critical:repeat' WHEN repeats >= 5 THEN 'warning:repeat' ELSE 'ok' END AS verdict FROM d"""


@query(_DETECT)
def loop_verdict(t):
    return calls.detect(_calls(t)).select("turn_id", "seq", "repeats", "streak", "ping_pong", "verdict")


@query(_DETECT.replace("event_type || ':' || props", "event_type").replace("event_type AS tool", "'t' AS tool"))
def loop_verdict_coarse(t):
    """The same with the type alone as arguments, so that loops occur."""
    coarse = _calls(t).join(t("events").select(F.col("event_id").alias("seq"), "event_type"), "seq").withColumn("tool", F.lit("t")).withColumn("args_hash", tx.short_hash(F.col("event_type"))).drop("event_type")
    return calls.detect(coarse).select("turn_id", "seq", "repeats", "streak", "ping_pong", "verdict")


# ---- text tools and stores


@query("SELECT doc_id::VARCHAR AS path, line::INT AS line, rtrim(l) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE regexp_matches(l, '(?i)licen[sc]e') ORDER BY path, line LIMIT 50")
def grep(t):
    return store.grep(t("documents").select(F.col("doc_id").cast("string").alias("path"), "text"), "licen[sc]e")


@query(r"SELECT page_id FROM pages WHERE regexp_matches(url, '^http.*/en/[^/]*$')")
def glob(t):
    return t("pages").where(F.col("url").rlike(tx.glob_pattern("http**/en/*"))).select("page_id")


@query("WITH c AS (SELECT doc_id, text, (length(text) - length(replace(text, 'rights reserved', ''))) // 15 AS n FROM documents) SELECT doc_id, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'replaced' END AS outcome, md5(CASE WHEN n = 1 THEN replace(text, 'rights reserved', 'r$1') ELSE text END) AS text_md5 FROM c")
def edit_once(t):
    edited = t("documents").select("doc_id", tx.replace_once(F.col("text"), F.lit("rights reserved"), F.lit("r$1")).alias("e"))
    return edited.select("doc_id", "e.outcome", F.md5(F.encode("e.text", "UTF-8")).alias("text_md5"))


@query("SELECT doc_id, md5(CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 600) || chr(10) || chr(10) || '... [' || (length(text) - 1000) || ' characters omitted] ...' || chr(10) || chr(10) || right(text, 400) END) AS text_md5 FROM documents")
def truncate_middle(t):
    return t("documents").select("doc_id", F.md5(F.encode(tx.truncate_middle(F.col("text"), 1000), "UTF-8")).alias("text_md5"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9\\x{4e00}-\\x{9fff}]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM pages")
def slugify(t):
    return t("pages").select("page_id", tx.slugify(F.col("url")).alias("slug"))


@query(rf"SELECT page_id, path FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(regexp_replace(url, '(\d)$', '\1.md'), '(?:^|[^\w/])([\w./-]+\.(?:{'|'.join(tx.PATH_EXTENSIONS)}))', 1))) AS path FROM pages)")
def extract_paths(t):
    return t("pages").select("page_id", F.explode(tx.extract_paths(F.regexp_replace("url", r"(\d)$", "$1.md"))).alias("path"))


def _markdown_sql(x: str) -> str:
    import re

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern, to in tx.markdown_steps():
        x = f"regexp_replace({x}, {quote(pattern)}, {quote(re.sub(r'[$](\d)', lambda m: chr(92) + m[1], to))}, 'g')"
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, md5({_markdown_sql('html')}) AS markdown_md5 FROM pages")
def html_to_markdown(t):
    return t("pages").select("page_id", F.md5(F.encode(tx.html_to_markdown(F.col("html")), "UTF-8")).alias("markdown_md5"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, (SELECT count(*) FROM customer WHERE c_nationkey::VARCHAR = '7')::BIGINT AS total FROM customer WHERE c_nationkey::VARCHAR = '7' ORDER BY c_custkey LIMIT 10")
def db_query(t):
    return store.where_equal(t("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_nationkey=7", 10, "c_custkey")


@query("SELECT DISTINCT event_type AS name FROM events WHERE event_type IN (SELECT trim(unnest(string_split('click, purchase,view', ','))))")
def tool_lookup(t):
    tools = t("events").select(F.col("event_type").alias("name")).distinct()
    return store.tool_lookup(tools, tools.sparkSession.createDataFrame([("click, purchase,view",)], "names string"))


def _store(t):
    old = t("labels").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("s"), (F.col("doc_id") % 10).cast("string")).alias("source"), F.lit("old").alias("model"), F.col("doc_id").alias("seq"))
    new = t("benchmark").select((F.col("item_id") * 2).cast("string").alias("id"), F.concat(F.lit("s"), (F.col("item_id") % 3).cast("string")).alias("source"), F.lit("new").alias("model"), F.col("item_id").alias("seq"))
    return old, new


_STORE = "o AS (SELECT doc_id::VARCHAR AS id, 's' || (doc_id % 10) AS source, 'old' AS model, doc_id AS seq FROM labels), n AS (SELECT (item_id * 2)::VARCHAR AS id, 's' || (item_id % 3) AS source, 'new' AS model, item_id AS seq FROM benchmark), l AS (SELECT max(seq) AS last FROM o)"


@query(f"WITH {_STORE}, f AS (SELECT n.*, o.seq AS old FROM n LEFT JOIN o USING (id)) SELECT id, source, model, seq FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, source, model, coalesce(old, last + row_number() OVER (PARTITION BY old IS NULL ORDER BY seq)) FROM f, l")
def upsert_in_place(t):
    return store.upsert_in_place(*_store(t))


@query(f"WITH {_STORE} SELECT id, source, model, seq FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, source, model, last + 1 + seq FROM n, l")
def upsert_at_end(t):
    return store.upsert_at_end(*_store(t))


@query(f"WITH {_STORE} SELECT model, count(*)::BIGINT AS n FROM (SELECT * FROM o UNION ALL SELECT * FROM n) WHERE model <> 'new' GROUP BY model")
def model_mismatch(t):
    old, new = _store(t)
    return store.model_mismatch(old.unionByName(new), "new")


@query("SELECT DISTINCT source FROM documents")
def distinct_sources(t):
    return store.sources(t("documents"))


@query("""SELECT doc_id, 'n' || doc_id AS name, source AS type, md5(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS body_md5 FROM documents""")
def front_matter_parse(t):
    raw = F.concat(F.lit("---\nname: x\ntype : "), "source", F.lit(" \nname:  n"), F.col("doc_id").cast("string"), F.lit("\n---\n"), "text")
    ok, meta, body = readers.front_matter(raw)
    return t("documents").where(ok).select("doc_id", meta["name"].alias("name"), meta["type"].alias("type"), F.md5(F.encode(body, "UTF-8")).alias("body_md5"))


@query("""WITH m AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'HTTP ' || (380 + event_id % 230) WHEN 1 THEN 'read ECONNRESET' WHEN 2 THEN 'bad input' WHEN 3 THEN 'fetch failed' ELSE 'code 12' END AS message FROM events), s AS (SELECT *, try_cast(nullif(regexp_extract(message, '(\\d{3})', 1), '') AS INT) AS status FROM m)
SELECT event_id, CASE WHEN status IN (408, 429, 529) OR status BETWEEN 500 AND 599 THEN true WHEN status BETWEEN 400 AND 499 THEN false ELSE regexp_matches(message, 'ECONNRESET|EPIPE|ETIMEDOUT|timeout|fetch failed|network|No output generated') END AS retryable, least(500 * pow(2, event_id % 10), 30000)::BIGINT AS backoff FROM s""")
def retry_policy(t):
    n = F.col("event_id")
    message = F.when(n % 5 == 0, F.concat(F.lit("HTTP "), (F.lit(380) + n % 230).cast("string"))).when(n % 5 == 1, "read ECONNRESET").when(n % 5 == 2, "bad input").when(n % 5 == 3, "fetch failed").otherwise("code 12")
    return t("events").select("event_id", tx.is_retryable(message).alias("retryable"), tx.backoff_ms(n % 10 + 1).alias("backoff"))


@query("""SELECT event_id, left(sha256('{"a":{"k":"' || event_type || '\\"\\n","u":' || user_id || '},"b":[true,null,"x"]}'), 16) AS hash FROM events""")
def stable_hash(t):
    """A nested object with characters to escape, keys in another order than the sorted one."""
    text = F.concat(F.lit('{"b": [true, null, "x"], "a": {"u": '), F.col("user_id").cast("string"), F.lit(', "k": "'), "event_type", F.lit('\\"\\n"}}'))
    return t("events").select("event_id", tx.short_hash(tx.stable_json_text(text)).alias("hash"))


@query(r"""SELECT doc_id, '{"a":' || to_json(text) || ',"b\"":"' || lang || '"}' AS body FROM documents""")
def stable_map(t):
    """A map with a quote in a key and whole texts as values."""
    return t("documents").select("doc_id", tx.stable_json(F.create_map(F.lit('b"'), "lang", F.lit("a"), "text")).alias("body"))


@query("SELECT event_type AS model, count(*)::BIGINT AS steps, sum(floor(value)::BIGINT)::BIGINT AS tokens, 0.0::DOUBLE AS cost FROM events GROUP BY event_type")
def stream_usage(t):
    """Totals by type of the event stream, from Structured Streaming over all folders of the table."""
    events = t("events")
    steps = None
    for pattern, folder in sorted({("events.parquet" if f.endswith("/events.parquet") else "*.parquet", f.rsplit("/", 1)[0]) for f in events.inputFiles()}):
        source = events.sparkSession.readStream.schema(events.schema).option("pathGlobFilter", pattern).parquet(folder)
        own = source.select(F.col("event_type").alias("model"), F.floor("value").cast("long").alias("tokens"), F.lit(0.0).alias("cost"))
        steps = own if steps is None else steps.unionByName(own)
    return logs.drain(logs.usage_totals(steps))


# ---- sources and small operators


def _notes(t):
    """Note and skill files made of the documents: some without front matter, a name or a known type."""
    kind = F.element_at(F.array(*map(F.lit, (*memory.DAYS, "other"))), (F.col("doc_id") % 5 + 1).cast("int"))
    head = F.concat(F.lit("---\nname: \"n"), F.col("doc_id").cast("string"), F.lit("\"\ntype: "), kind, F.lit("\ndescription: about "), "lang", F.lit("\nlastWriteAt: "), (F.col("doc_id") * 7).cast("string"), F.lit("\nlastReadAt: never\n---\n\n"))
    body = F.concat(F.lit("body of "), "source")
    return t("documents").select("doc_id", F.concat(F.lit("skills/s"), F.col("doc_id").cast("string"), F.lit("/SKILL.md")).alias("path"), F.when(F.col("doc_id") % 7 == 0, body).otherwise(F.concat(head, body)).alias("text"))


_KIND = "['user', 'feedback', 'project', 'reference', 'other'][doc_id % 5 + 1]"


@query(f"""SELECT 'skills/s' || doc_id || '/SKILL.md' AS path, '"n' || doc_id || '"' AS name, 'about ' || lang AS description, {_KIND} AS type, 'body of ' || source AS content, doc_id * 7 AS last_write, NULL::BIGINT AS last_read FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 4""")
def memory_scan(t):
    """Entries of note files; files without front matter or of an unknown type are skipped."""
    return readers.memories(_notes(t))


@query("""SELECT 'skills/s' || doc_id || '/SKILL.md' AS path, CASE WHEN doc_id % 7 = 0 THEN 's' || doc_id ELSE 'n' || doc_id END AS name, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'about ' || lang END AS description, 'body of ' || source AS body FROM documents""")
def skill_scan(t):
    """Skill files; without front matter the folder names them."""
    return readers.skills(_notes(t))


@query("""SELECT conv_id::VARCHAR AS timestamp, role, text AS content FROM conversations WHERE turn % 2 = 0""")
def session_scan(t):
    """A session log written as JSON lines and read back; lines of another type are skipped."""
    kind = F.when(F.col("turn") % 2 == 0, "message").otherwise("note")
    rows = t("conversations").select(kind.alias("type"), F.col("conv_id").cast("string").alias("timestamp"), F.struct("role", F.col("text").alias("content")).alias("message"))
    path = scratch.new_folder(rows.sparkSession, "session")
    readers.append_json(rows, path)
    return readers.session(rows.sparkSession, path)


@query("""SELECT item_id::VARCHAR AS id, text AS query, 's' AS source, text AS "goldenAnswer", 'factoid' AS tag, 'synth' AS origin FROM benchmark""")
def golden_scan(t):
    """Golden items written as JSON lines and read back."""
    rows = t("benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.lit("s").alias("source"), F.col("text").alias("goldenAnswer"), F.array(F.lit("factoid")).alias("tags"), F.lit("synth").alias("origin"))
    path = scratch.new_folder(rows.sparkSession, "golden")
    readers.append_json(rows, path)
    return readers.golden(rows.sparkSession, path).withColumn("tag", F.col("tags")[0]).drop("tags")


@query(f"""WITH e AS (SELECT 'doc ' || doc_id AS name, doc_id % 4 AS type, {t3("'doc ' || doc_id || ' ' || text")} AS ts FROM documents), c AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'doc ' ELSE 'item ' END || item_id AS name, item_id % 4 AS type, text FROM benchmark), d AS (SELECT name, type, {t3("name || ' ' || text")} AS ts FROM c),
a AS (SELECT name AS candidate, type, len(ts) AS na, unnest(ts) AS token FROM d), b AS (SELECT name, type, len(ts) AS nb, unnest(ts) AS token FROM e),
o AS (SELECT candidate FROM a JOIN b USING (type, token) WHERE name <> candidate GROUP BY candidate, name, na, nb HAVING count(*)::DOUBLE / least(na, nb) >= 0.34)
SELECT name, CASE WHEN (name, type) IN (SELECT (name, type) FROM e) THEN 'update' WHEN name IN (SELECT candidate FROM o) THEN 'duplicate' ELSE 'create' END AS action FROM c""")
def memory_save(t):
    """What saving each benchmark item as a memory comes to."""
    entries = t("documents").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), (F.col("doc_id") % 4).alias("type"), F.col("text").alias("description"))
    name = F.concat(F.when(F.col("item_id") % 2 == 0, "doc ").otherwise("item "), F.col("item_id").cast("string"))
    candidate = t("benchmark").select(name.alias("name"), (F.col("item_id") % 4).alias("type"), F.col("text").alias("description"))
    return memory.save(entries, candidate).select("name", "action")


@query(f"SELECT conv_id, sum(3 + {_EST})::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def message_tokens(t):
    return usage.message_tokens(_messages(t))


@query("SELECT DISTINCT event_type || user_id AS name FROM events WHERE user_id % 3 <> 0 OR event_type = 'click'")
def visible_tools(t):
    tools = t("events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("name"), (F.col("user_id") % 3 == 0).alias("deferred"), "event_type").distinct()
    return store.visible_tools(tools, tools.where("event_type = 'click'")).select("name")


@query("SELECT event_id, lower(to_base(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END), 36)) AS hash FROM (SELECT event_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split('编' || event_type || props, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) & 4294967295) AS h FROM events)")
def rolling_hash(t):
    return t("events").select("event_id", tx.rolling_hash(F.concat(F.lit("编"), "event_type", "props")).alias("hash"))


@query("SELECT item_id, CASE item_id % 3 WHEN 0 THEN ['a' || item_id, 'b]'] ELSE [] END AS parts FROM benchmark".replace("AS parts FROM benchmark", "AS p FROM benchmark").replace("SELECT item_id, CASE", "SELECT item_id, coalesce(array_to_string(p, '|'), '') AS parts FROM (SELECT item_id, CASE") + ")")
def json_array(t):
    """Replies with an array among other text, with none, and with a malformed one."""
    n = F.col("item_id")
    reply = F.when(n % 3 == 0, F.concat(F.lit('Here:\n["a'), n.cast("string"), F.lit('", "b]"] ok'))).when(n % 3 == 1, F.col("text")).otherwise(F.lit("[oops"))
    return t("benchmark").select("item_id", F.array_join(tx.json_array(reply), "|").alias("parts"))


@query("""WITH r AS (SELECT item_id, text, item_id % 4 AS k FROM benchmark), i AS (SELECT item_id AS seq, 0 AS nth, left(text, 20) AS query, text AS answer FROM r WHERE k <> 3 UNION ALL SELECT item_id, 1, 'second ' || item_id, text FROM r WHERE k = 1)
SELECT format('syn-{:03d}', row_number() OVER (ORDER BY seq, nth)) AS id, query, 'bench' AS source, answer FROM i""")
def synthetic_items(t):
    """Golden items of a generator's replies: one, two of three, one of two without a query, or none."""
    n, item = F.col("item_id"), lambda q, a: F.struct(q.alias("query"), a.alias("goldenAnswer"), F.array(F.lit("factoid")).alias("tags"))
    first, more = item(F.left("text", F.lit(20)), F.col("text")), item(F.concat(F.lit("second "), n.cast("string")), F.col("text"))
    reply = F.when(n % 4 == 0, F.to_json(F.array(first))).when(n % 4 == 1, F.to_json(F.array(first, more, more))).when(n % 4 == 2, F.to_json(F.array(first, item(F.lit(""), F.col("text"))))).otherwise(F.lit("no array"))
    raw = t("benchmark").select(n.alias("seq"), F.lit("bench").alias("source"), F.concat(F.lit("Sure: "), reply).alias("reply"))
    return evaluation.synthetic_items(raw).select("id", "query", "source", "answer")


_INGESTED = f"ch AS (SELECT doc_id::VARCHAR || '#' || index AS id, doc_id::VARCHAR AS source, index, text FROM ({_windows(819, 819)}))"


@query(f"""WITH {_INGESTED}, od AS (SELECT id, source, 'old' AS model, seq FROM (SELECT *, row_number() OVER (ORDER BY source, index) - 1 AS seq FROM ch WHERE source::BIGINT % 2 = 0)), nw AS (SELECT id, source, 'new' AS model, row_number() OVER (ORDER BY source, index) AS nth FROM ch WHERE source::BIGINT % 3 = 0)
SELECT id, source, model, seq FROM od WHERE id NOT IN (SELECT id FROM nw) UNION ALL SELECT id, source, model, nth + (SELECT coalesce(max(seq), -1) FROM od) FROM nw""")
def knowledge_ingest(t):
    """A base of every second document, and then every third with another model: chunk, embed, upsert."""
    docs, spark = _sourced(t), t("documents").sparkSession
    none = spark.createDataFrame([], "id string, source string, text string, vector array<double>, model string, seq long")
    base = knowledge.Base(none, model="old", dims=8).ingest(docs.where("source % 2 = 0"), "fixed-size")
    return replace(base, model="new").ingest(docs.where("source % 3 = 0"), "fixed-size").chunks.select("id", "source", "model", "seq")


@query("SELECT 'labels' AS name, 'doc_id,quality,toxic' AS columns, count(*)::BIGINT AS rows FROM labels UNION ALL SELECT 'benchmark', 'item_id,text', count(*) FROM benchmark")
def table_list(t):
    return store.table_list({n: t(n) for n in ("labels", "benchmark")})


@query("SELECT user_id % 2 = 0 AS deferred, sum(ceil(length(props) / 4.0))::BIGINT AS tokens FROM events GROUP BY 1")
def schema_tokens(t):
    return store.schema_tokens(t("events").select(F.col("props").alias("schema"), (F.col("user_id") % 2 == 0).alias("deferred")))


@query("SELECT user_id AS query_id, event_id AS chunk_id, value AS rank, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id)::INT AS place, event_type FROM events QUALIFY place <= 3")
def full_text_hits(t):
    """Hits with a rank, joined back to their chunks."""
    hits = t("events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), F.col("value").alias("rank"))
    return store.full_text_hits(hits, t("events").select(F.col("event_id").alias("chunk_id"), "event_type"), 3).select("query_id", "chunk_id", "rank", "place", "event_type")


_CJK_TEXT = "'数据' || lang || '检索引擎 的' || doc_id || ' a1_b C9'"


@query("SELECT doc_id, " + ", ".join(f"array_to_string({f(_CJK_TEXT) if f in (t1, t2) else f'list_sort({f(_CJK_TEXT)})'}, '|') AS {n}" for f, n in ((t1, "retrieval"), (t2, "memory"), (t3, "duplicate"), (t4, "matching"))) + " FROM documents")
def tok_cjk(t):
    """The four tokenizers on CJK, ASCII and digits side by side."""
    text = F.concat(F.lit("数据"), "lang", F.lit("检索引擎 的"), F.col("doc_id").cast("string"), F.lit(" a1_b C9"))
    found = {"retrieval": tok.retrieval_tokens(text), "memory": tok.memory_tokens(text), "duplicate": F.array_sort(tok.duplicate_tokens(text)), "matching": F.array_sort(tok.matching_tokens(text))}
    return t("documents").select("doc_id", *(F.array_join(tokens, "|").alias(n) for n, tokens in found.items()))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of all benchmark items over all documents."""
    return QUERIES["hybrid_search"](spark, sf_dir)
