"""DuckDB SQL of the corpus queries that SQL can express."""

OP1 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT norm, arg_min(doc_id, (-cp, doc_id)) AS keep_id, count(*) AS group_size FROM (SELECT doc_id, -cp AS k, cp, norm FROM d) GROUP BY norm)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""

OP2 = r"""
WITH r AS (SELECT doc_id, source, CAST(length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|mix-1')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS ord FROM s),
w AS (SELECT *, CAST([3, 1, 2][CAST(ord % 3 AS INT) + 1] AS BIGINT) AS weight, CAST([-0.5, 0.0, 0.5][CAST(ord % 3 AS INT) + 1] AS DOUBLE) AS slope FROM n),
f AS (SELECT *, 3 * sum(source_size) OVER () - 2 * coalesce(sum(2 * source_size) OVER o, 0) AS left2,
  sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS w_left FROM w
  WINDOW o AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT left2, w_left FROM f WHERE CAST(left2 AS DOUBLE) <= CAST(4 * source_size * w_left AS DOUBLE) / weight ORDER BY CAST(2 * source_size AS DOUBLE) / weight, ord LIMIT 1),
t AS (SELECT source, source_size, slope, least(CAST(CAST(weight * left2 AS BIGINT) AS DOUBLE) / CAST(CAST(2 * w_left AS BIGINT) AS DOUBLE), CAST(2 * source_size AS DOUBLE)) AS target FROM w, l),
x AS (SELECT r.doc_id, r.size, t.source_size, t.target, t.slope,
  CAST(coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM x),
z AS (SELECT *, CASE WHEN size > 0 THEN rounds + CAST(start < target - rounds * source_size AS BIGINT) ELSE 0 END AS copies FROM y)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies,
  CASE WHEN copies > 0 THEN 2 * least(start / target, 1.0) / (1 - slope + sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * least(start / target, 1.0), 0))) END AS position
FROM z
"""

OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a WHERE r.root < e.b),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.id = w.doc_id
"""

OP5 = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e) AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON r.id = l.a WHERE r.root < l.b),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.k, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

OP7 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, h, unnest(range(0, CAST(ceil(length(h) / 2000.0) AS BIGINT))) AS c FROM d),
e AS (SELECT doc_id, c, substr(h, 2000 * c + 1, 2200) AS s, CAST(length(h) / 2 AS BIGINT) AS n FROM c),
b AS (SELECT doc_id, c, s, n, unnest(range(0, least(1000, n - 1000 * c))) AS i FROM e),
w AS (SELECT doc_id, 1000 * c + i AS p, substr(s, 2 * i + 1, 2) AS x, CASE WHEN 1000 * c + i + 100 <= n THEN md5(substr(s, 2 * i + 1, 200)) END AS k FROM b),
m AS (SELECT k, min(CAST(doc_id AS HUGEINT) * 4294967296 + p) AS at FROM w WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
f AS (SELECT doc_id, p, x, m.k IS NOT NULL AND m.at <> CAST(doc_id AS HUGEINT) * 4294967296 + p AS again FROM w LEFT JOIN m ON m.k = w.k),
g AS (SELECT doc_id, p, x, max(CAST(again AS INT)) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) = 0 AS opens FROM g),
a AS (SELECT doc_id, count(*) AS n_bytes, sum(gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (gone = 0) AS left_hex FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_hex, ''))) AS kept_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

OP10 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, html, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) % 32 AS INT), 1)), 'string_agg', '') AS payload_digest FROM p),
g AS (SELECT html, max(page_id) AS keep FROM q GROUP BY html)
SELECT q.page_id, payload_bytes, payload_digest, CASE WHEN q.page_id = g.keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN q.page_id <> g.keep THEN g.keep END AS refers_to
FROM q JOIN g ON q.html = g.html
"""

SQL = {"op1_exact_dedup": OP1, "op2_mixing": OP2, "op4_minhash_near_dedup": OP4, "op5_embedding_near_dedup": OP5, "op7_suffix_dedup": OP7, "op10_warc": OP10}
