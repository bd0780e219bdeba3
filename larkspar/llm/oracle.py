"""SQL (DuckDB) for those operators whose results plain SQL can state, written without their methods."""

WORDS = r"[^\x20\x09-\x0D]+"

OP2_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT r, doc_id, hex(b) AS x, octet_length(b) AS n FROM d),
w AS (SELECT r, i, hash(b[i + 1:i + 400]) AS v FROM (SELECT r, b, unnest(range(0, octet_length(b) - 399)) AS i FROM d WHERE octet_length(b) >= 400)),
again AS (SELECT r, i FROM w SEMI JOIN (SELECT v FROM w GROUP BY v HAVING count(*) > 1) USING (v)),
edge AS (SELECT r, i, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000000) > 400 AS begins FROM again),
span AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(begins::INT) OVER (PARTITION BY r ORDER BY i) AS k FROM edge) GROUP BY r, k),
cut AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM span UNION ALL SELECT r, max(b), NULL FROM span GROUP BY r),
kept AS (SELECT h.r, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a, b) AS x FROM h JOIN cut USING (r) GROUP BY h.r),
gone AS (SELECT r, sum(b - a) AS n, count(*) AS k FROM span GROUP BY r)
SELECT doc_id, CAST(h.n AS BIGINT) AS n_bytes, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, coalesce(gone.k, 0) AS n_spans, sha256(unhex(coalesce(kept.x, h.x))) AS kept_sha256
FROM h LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)
"""

OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
w AS (SELECT r, i, md5_number(array_to_string(ws[i:i + 34], ' ')) AS v FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
again AS (SELECT r, i FROM w SEMI JOIN (SELECT v FROM w GROUP BY v HAVING count(*) > 1) USING (v)),
gone AS (SELECT DISTINCT r, i + j AS i FROM again, range(35) t(j)),
words AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""

OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM d),
n AS (SELECT r, doc_id, CAST(len(sh) AS BIGINT) AS n FROM s), u AS (SELECT r, unnest(sh) AS x FROM s),
o AS (SELECT a.r AS p, b.r AS q, count(*) AS o FROM u a JOIN u b ON a.x = b.x AND a.r <> b.r GROUP BY ALL),
link AS (SELECT p, q FROM o JOIN n a ON a.r = p JOIN n b ON b.r = q WHERE 100 * o >= 90 * (a.n + b.n - o)),
reach AS (SELECT r AS p, r AS q FROM n UNION SELECT reach.p, link.q FROM reach JOIN link ON reach.q = link.p),
c AS (SELECT reach.p AS r, min(n.doc_id) AS component_id FROM reach JOIN n ON n.r = reach.q GROUP BY reach.p), k AS (SELECT p AS r, count(*) AS k FROM link GROUP BY p)
SELECT doc_id, n AS n_shingles, component_id, coalesce(k, 0) AS n_links FROM n JOIN c USING (r) LEFT JOIN k USING (r)
"""
