"""DuckDB SQL of the operators that SQL can express on whole small tables."""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN f USING (k) WHERE first < doc_id),
own AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT o.doc_id, string_agg(word, ' ' ORDER BY o.j) AS t, count(*) AS n FROM own o ANTI JOIN gone g ON o.doc_id = g.doc_id AND o.j = g.j GROUP BY o.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM n WHERE n >= 50)),
f AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (SELECT doc_id, i FROM win JOIN f USING (k) WHERE first < doc_id),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM gone)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y, b - a AS size, 1 AS span FROM spans UNION ALL SELECT n.doc_id, coalesce(max(b), 0), n.n, 0, 0 FROM n LEFT JOIN spans USING (doc_id) GROUP BY n.doc_id, n.n)
SELECT doc_id, max(n)::BIGINT AS n_bytes, sum(size)::BIGINT AS n_removed, sum(span)::BIGINT AS n_spans, sha256(unhex(string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x))) AS kept_sha256 FROM gaps JOIN n USING (doc_id) GROUP BY doc_id
"""

NGRAM_JOIN = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, min(b) AS component_id FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, g
"""

#: Base32 digits of the SHA-1, five bits at a time.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h FROM p),
v AS (SELECT page_id, n, h, list_transform(range(0, 4), lambda k: ('0x' || substr(h, 10 * k + 1, 10))::BIGINT) AS q FROM b),
t AS (SELECT page_id, n, h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((q[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31) + 1)::INT, 1)), '') AS digest FROM v),
f AS (SELECT h, min(page_id) AS first FROM t GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM t JOIN f USING (h)
"""
