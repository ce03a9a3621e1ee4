"""DuckDB SQL with the same rows as the operators' queries, where SQL can express them."""

from __future__ import annotations

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWER}, '{WORD}')"

#: Classes by exact comparison of all documents that share a shingle, and components by recursion.
NEARDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS l FROM documents),
u AS (SELECT array_to_string(l, ' ') AS k, any_value(l) AS l, min(doc_id) AS rep FROM w WHERE len(l) > 0 GROUP BY 1),
s AS (SELECT rep, unnest(CASE WHEN len(l) < 5 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) END) AS g FROM u),
m AS (SELECT rep, md5_number(g) AS g, count(*) AS c FROM s GROUP BY ALL),
n AS (SELECT rep, sum(c) AS n FROM m GROUP BY rep),
e AS (SELECT a.rep AS a, b.rep AS b, sum(least(a.c, b.c)) AS shared FROM m a JOIN m b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
near AS (SELECT a, b FROM e JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE shared >= 0.8 * (x.n + y.n - shared)),
links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT rep AS a, rep AS b FROM u UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
d AS (SELECT w.doc_id, coalesce(c.class_id, w.doc_id) AS class_id FROM w LEFT JOIN u ON array_to_string(w.l, ' ') = u.k LEFT JOIN c ON c.rep = u.rep)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM d
"""

#: Every 100-byte string by its hash; the spans of those that start earlier are merged.
REPEATS = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS pos, h FROM d),
k AS (SELECT doc_id, pos, md5_number(substr(h, 2 * pos + 1, 200)) AS g FROM w),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) AS n FROM k) WHERE n > 1),
i AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 100 THEN 0 ELSE 1 END AS new FROM r),
p AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM i),
x AS (SELECT doc_id, min(pos) AS s, max(pos) + 100 AS e FROM p GROUP BY doc_id, run),
c AS (SELECT doc_id, s, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS kept_from FROM x),
y AS (SELECT c.doc_id, string_agg(substr(h, 2 * kept_from + 1, 2 * (s - kept_from)), '' ORDER BY s) AS kept FROM c JOIN d USING (doc_id) GROUP BY c.doc_id),
z AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last FROM x GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)
"""

#: Prefix filter on exact word counts, then exact overlaps.
LINES = r"""
WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, line, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS ws FROM l),
q AS (SELECT doc_id, line, array_to_string(ws, ' ') AS s, ws FROM k WHERE len(ws) > 0),
f AS (SELECT s, any_value(ws) AS ws, min((doc_id, line)) AS pos FROM q GROUP BY s),
t AS (SELECT s, len(ws) AS n, unnest(ws) AS w FROM f),
c AS (SELECT w, count(*) AS c FROM t GROUP BY w),
o AS (SELECT s, n, w, row_number() OVER (PARTITION BY s ORDER BY c, w) AS i FROM t JOIN c USING (w)),
p AS (SELECT s, n, w FROM o WHERE i <= n - ceil(0.8 * n - 1e-9) + 1),
m AS (SELECT DISTINCT a.s AS a, b.s AS b, a.n + b.n AS n FROM p a JOIN p b ON a.w = b.w AND a.s < b.s AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9),
v AS (SELECT m.a, m.b FROM m JOIN f x ON x.s = m.a JOIN f y ON y.s = m.b WHERE len(list_intersect(x.ws, y.ws)) >= ceil(0.8 / 1.8 * m.n - 1e-9)),
g AS (SELECT DISTINCT CASE WHEN x.pos > y.pos THEN v.a ELSE v.b END AS s FROM v JOIN f x ON x.s = v.a JOIN f y ON y.s = v.b),
r AS (SELECT q.doc_id, q.line FROM q JOIN f USING (s) WHERE (q.doc_id, q.line) <> f.pos OR q.s IN (SELECT s FROM g)),
n AS (SELECT doc_id, count(*) AS n_lines FROM q GROUP BY doc_id),
z AS (SELECT doc_id, count(*) AS n_removed, string_agg(line::VARCHAR, ',' ORDER BY line) AS removed FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN z USING (doc_id)
"""

#: Windows of eight words, or of a shorter item's all, joined by their text.
CONTAMINATION = f"""
WITH b AS (SELECT item_id, {WORDS} AS l FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(l) - n + 2), lambda i: array_to_string(l[i:i + n - 1], ' '))) AS g FROM (SELECT item_id, l, least(8, len(l)) AS n FROM b) WHERE n > 0),
d AS (SELECT doc_id, {WORDS} AS l FROM documents),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(l) - n + 2)) AS i, unnest(list_transform(range(1, len(l) - n + 2), lambda i: array_to_string(l[i:i + n - 1], ' '))) AS g FROM d, sizes WHERE len(l) >= n),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hw AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(l) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

#: All products; the sum runs over the components in order.
NEAREST = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

SQL = {
    "op1_neardup": NEARDUP,
    "op2_repeats": REPEATS,
    "op4_lines": LINES,
    "op5_decontaminate": CONTAMINATION,
    "op9_nearest": NEAREST,
}
