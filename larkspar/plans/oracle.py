"""SQL (DuckDB) for the registered queries, written apart from them: by windows, recursion and plain joins."""

V = "v AS (SELECT vec_id AS key, CAST(label AS BIGINT) AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
CENT = """cent AS (SELECT cluster, list(m ORDER BY i) AS centroid FROM (
  SELECT cluster, i, avg(x) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM v) GROUP BY ALL) GROUP BY cluster)"""
ORDERED = "o AS (SELECT *, row_number() OVER (ORDER BY cluster, key) AS position FROM v)"
PAGE_KEY = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
LABELS = """r AS (SELECT d.doc_id, d.source, d.lang AS label, CASE WHEN coalesce(toxic, 0) = 1 THEN 'animal' ELSE 'Bird ' END AS category,
  CASE WHEN d.doc_id % 11 = 0 THEN 'n/a' ELSE CAST((d.doc_id % 100) / 100 AS VARCHAR) END AS confidence,
  CASE WHEN quality = 1 THEN 'kept-existing' ELSE 'written' END AS applied, CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE 'bird' END AS prior_category,
  CASE WHEN d.doc_id % 5 = 0 THEN 'no label' ELSE 'odd;xx-yy-' || d.source || ' bird(' || (d.doc_id % 101) || '%)' END AS prior_label
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
SELECTION = rf"""{LABELS}, h AS (SELECT *, applied = 'kept-existing' AND prior_category <> '' AS kept, doc_id % 5 <> 0 AS parsed, lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0') AS y FROM r),
  e AS (SELECT doc_id, CASE WHEN kept THEN prior_category ELSE lower(trim(category)) END AS effective_category, CASE WHEN NOT kept THEN lower(label) WHEN parsed THEN source || ' bird' END AS species,
    CASE WHEN NOT kept THEN coalesce(TRY_CAST(confidence AS DOUBLE), 0) WHEN parsed THEN (doc_id % 101) / 100 END AS sure, doc_id % 31 = 0 AS blank, source, y FROM h),
  o AS (SELECT doc_id, CASE WHEN blank THEN 'no_image_path' WHEN y = '29' OR (doc_id % 30 < 15 AND source = 'src1') THEN 'filtered_out' WHEN effective_category NOT IN ('bird', 'animal') THEN 'not_selected'
      WHEN sure < 0.25 THEN 'below_min_confidence' WHEN doc_id % 17 = 0 THEN 'missing_image' ELSE 'resolved' END AS outcome, effective_category, species, round(sure, 4) AS sure,
    CASE WHEN blank THEN '' ELSE 'Photos-' || y END AS library, CASE WHEN blank THEN '' ELSE source END AS trip, CASE WHEN blank THEN '' ELSE CAST(doc_id AS VARCHAR) END AS stem, CASE WHEN NOT blank THEN '20' || y END AS year FROM e)"""
PARTS = """p AS (SELECT *, CASE WHEN p_partkey % 13 = 0 THEN p_name WHEN p_partkey % 13 = 1 THEN 'bird'
  ELSE replace(p_brand, '#', '') || '-' || p_type || '-' || p_name || '(' || p_size || '%)' END AS text FROM part)"""
TRIPS = """t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS captured, CASE
    WHEN o_orderkey % 17 = 0 THEN strftime(s, '%Y') || '-13-40 odd' WHEN o_orderkey % 3 = 0 THEN strftime(s, '%Y-%m')
    ELSE strftime(s, '%Y-%m-%d') || ' ' || o_orderstatus END AS trip,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN CAST(date_trunc('month', s) AS DATE) ELSE s END AS d,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'month' ELSE 'day' END AS prec
  FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 5 AS INTEGER) AS DATE) AS s FROM orders)),
  q AS (SELECT *, CASE prec WHEN 'month' THEN CASE WHEN date_trunc('month', captured) = d THEN 0 ELSE abs(date_diff('day', d, CAST(date_trunc('month', captured) AS DATE))) END
    WHEN 'day' THEN abs(date_diff('day', d, captured)) END AS days_off FROM t)"""
TREES = r"""b AS (SELECT p_partkey AS k, p_type || '/' || (p_size % 5) AS folder, replace(p_name, ' ', '') || CAST(floor(p_partkey / 7) AS BIGINT) AS base FROM part),
  img AS (SELECT DISTINCT folder, base || CASE k % 7 WHEN 1 THEN '-2' WHEN 2 THEN '-2-3' WHEN 3 THEN '-Enhanced-NR' WHEN 4 THEN '-Pano' ELSE '' END AS stem FROM b WHERE k % 11 <> 0),
  side AS (SELECT DISTINCT CASE WHEN k % 29 = 0 THEN 'unexported' ELSE folder END AS folder, base || CASE WHEN k % 3 = 1 THEN '-2' ELSE '' END AS stem FROM b WHERE k % 7 < 3),
  claim AS (SELECT folder, stem, base FROM (SELECT i.folder, i.stem, s.stem AS base, row_number() OVER (PARTITION BY i.folder, i.stem ORDER BY len(s.stem) DESC) AS n
    FROM img i LEFT JOIN side s ON i.folder = s.folder AND (i.stem = s.stem OR starts_with(i.stem, s.stem || '-'))) WHERE n = 1)"""
NN = """nn AS (SELECT a.key, arg_min(b.key, (-round(list_cosine_similarity(a.v, b.v), 12), b.key)) AS other, max(round(list_cosine_similarity(a.v, b.v), 12)) AS cosine
  FROM v a JOIN v b ON a.key <> b.key GROUP BY a.key)"""
FRAMES = """f AS (SELECT year(o_orderdate) AS "group", strftime(o_orderdate, '%Y-%m-%d') AS trip, CAST(dayofyear(o_orderdate) AS BIGINT) AS pos,
  l_returnflag || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS key, l_returnflag AS code, l_partkey AS num FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CONFLICTS = """c AS (SELECT "group", pos, max(before) AS last FROM (SELECT "group", pos, lag(pos) OVER (PARTITION BY "group", key ORDER BY pos) AS before
  FROM (SELECT DISTINCT "group", pos, key FROM f)) GROUP BY ALL)"""
WALK = """walk AS (SELECT "group", min(pos) AS at FROM c GROUP BY "group"
  UNION ALL SELECT w."group", (SELECT min(pos) FROM c WHERE c."group" = w."group" AND c.last >= w.at) FROM walk w
    WHERE (SELECT min(pos) FROM c WHERE c."group" = w."group" AND c.last >= w.at) IS NOT NULL),
  seg AS (SELECT c."group", c.pos, count(w.at) AS segment FROM c JOIN walk w ON w."group" = c."group" AND w.at <= c.pos GROUP BY ALL)"""
USERS = "u AS (SELECT row_number() OVER (ORDER BY user_id) AS position, n AS size FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id))"

ORACLE_SQL: dict[str, str] = {
    "cluster_report": f"""WITH {V}, {CENT}, s AS (SELECT a.cluster, a.key, round(sum(sqrt(greatest(0, 2 - 2 * list_inner_product(a.v, b.v)))), 6) AS s FROM v a JOIN v b USING (cluster) GROUP BY ALL),
      m AS (SELECT cluster, count(*) AS size, arg_min(key, (s, key)) AS medoid FROM s GROUP BY cluster)
      SELECT m.cluster AS label, size, medoid, round(sqrt(list_inner_product(centroid, centroid)), 6) AS centroid_norm, round(list_distance(v.v, centroid), 6) AS centroid_medoid_gap
      FROM m JOIN cent USING (cluster) JOIN v ON v.cluster = m.cluster AND v.key = medoid""",
    "cluster_size_marked": "SELECT row_number() OVER (ORDER BY vec_id) AS seq, vec_id, label AS cluster_id, CASE WHEN label <> 0 THEN count(*) OVER (PARTITION BY label) END AS cluster_size FROM embeddings",
    "label_agreement": """WITH p AS (SELECT source, lang, count(*) AS n FROM documents WHERE coalesce(lang, '') <> '' GROUP BY ALL),
      a AS (SELECT count(*) AS clusters_labelled, count(*) FILTER (l = 1) AS single_label_clusters, round(avg(s), 6) AS mean_dominant_share FROM (SELECT count(*) AS l, max(n) / sum(n) AS s FROM p GROUP BY source)),
      b AS (SELECT count(*) AS labels_seen, count(*) FILTER (c > 1) AS labels_split FROM (SELECT count(*) AS c FROM p GROUP BY lang)) SELECT * FROM a, b""",
    "dominant_share": """SELECT source, rows, lang AS dominant, round(n / rows, 6) AS purity FROM (SELECT source, lang, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY source) AS BIGINT) AS rows,
      row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS k FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) WHERE k = 1""",
    "run_summary": """WITH s AS (SELECT label, count(*) AS n FROM embeddings WHERE label <> 0 GROUP BY label)
      SELECT (SELECT count(*) FROM s) AS clusters, (SELECT CAST(floor(median(n)) AS BIGINT) FROM s) AS median_size, count(*) AS rows, count(*) FILTER (label = 0) AS noise, round(count(*) FILTER (label = 0) / count(*), 4) AS noise_fraction,
      (SELECT string_agg(n, ',' ORDER BY n DESC) FROM (SELECT n FROM s ORDER BY n DESC LIMIT 10)) AS largest FROM embeddings""",
    "homogeneity_completeness": """WITH t AS (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY source) AS c, sum(n) OVER (PARTITION BY lang) AS l, sum(n) OVER () AS t FROM t),
      h AS (SELECT -sum(n / t * ln(n / c)) AS hlc, -sum(n / t * ln(n / l)) AS hcl, -sum(n / t * ln(l / t)) AS hl, -sum(n / t * ln(c / t)) AS hc FROM x),
      y AS (SELECT CASE WHEN hl = 0 THEN 1 ELSE 1 - hlc / hl END AS a, CASE WHEN hc = 0 THEN 1 ELSE 1 - hcl / hc END AS b FROM h)
      SELECT round(a, 6) AS homogeneity, round(b, 6) AS completeness, round(CASE WHEN a + b = 0 THEN 0 ELSE 2 * a * b / (a + b) END, 6) AS v_measure FROM y""",
    "path_scope_filter": f"""WITH p AS (SELECT page_id, {PAGE_KEY} AS key FROM pages), h AS (SELECT *, split_part(key, '/', 1) AS host, split_part(key, '/', 2) AS lang FROM p)
      SELECT page_id, key FROM h WHERE lang IN ('en', 'fr') AND host <> (SELECT min(host) FROM h) AND NOT (lang = 'fr' AND host = (SELECT max(host) FROM h WHERE lang = 'fr'))""",
    "path_parts": f"""WITH p AS (SELECT page_id, string_split({PAGE_KEY}, '/') AS a FROM pages)
      SELECT page_id, a[1] AS library, array_to_string(a[2:len(a) - 1], '/') AS trip, regexp_replace(a[len(a)], '\\.[^.]*$', '') AS stem, '20' || lpad(CAST(page_id % 30 AS VARCHAR), 2, '0') AS year FROM p""",
    "scope_funnel": """SELECT count(*) AS rows, count(*) FILTER (a) AS in_scope, count(*) FILTER (a AND b) AS labelled, count(*) FILTER (a AND b AND c) AS selected, count(*) FILTER (a AND b AND c AND d) AS confident, count(*) FILTER (a AND b AND c AND d AND e) AS long_enough
      FROM (SELECT source <> 'src0' AS a, quality IS NOT NULL AS b, lang IN ('en', 'de') AS c, quality = 1 AS d, n_chars >= 200 AS e FROM documents LEFT JOIN labels USING (doc_id))""",
    "effective_label": rf"""WITH {LABELS}, x AS (SELECT *, applied = 'kept-existing' AND prior_category <> '' AS kept, doc_id % 5 <> 0 AS parsed FROM r)
      SELECT doc_id, CASE WHEN kept THEN prior_category ELSE lower(trim(category)) END AS category, CASE WHEN NOT kept THEN lower(label) WHEN parsed THEN source || ' bird' END AS species,
      round(CASE WHEN NOT kept THEN coalesce(TRY_CAST(confidence AS DOUBLE), 0) WHEN parsed THEN (doc_id % 101) / 100 END, 4) AS confidence FROM x""",
    "candidate_selection": f"WITH {SELECTION} SELECT * FROM o",
    "selection_report": f"""WITH {SELECTION}, x AS (SELECT *, outcome NOT IN ('no_image_path', 'filtered_out') AS inside, outcome IN ('below_min_confidence', 'missing_image', 'resolved') AS chosen FROM o)
      SELECT 'rows' AS counter, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM x HAVING count(*) > 0 UNION ALL SELECT outcome, NULL, count(*) FROM x WHERE outcome <> 'not_selected' GROUP BY outcome
      UNION ALL SELECT 'in_scope', NULL, count(*) FROM x WHERE inside HAVING count(*) > 0 UNION ALL SELECT 'selected', NULL, count(*) FROM x WHERE chosen HAVING count(*) > 0
      UNION ALL SELECT 'category', effective_category, count(*) FROM x WHERE chosen GROUP BY ALL UNION ALL SELECT 'year', year, count(*) FROM x WHERE outcome = 'resolved' GROUP BY ALL
      UNION ALL SELECT 'species', NULL, count(DISTINCT species) FROM x WHERE outcome = 'resolved'""",
    "relabel_filter": f"""WITH {LABELS}, x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE trim(category) END AS c, confidence, CASE doc_id % 7 WHEN 0 THEN 'animal' WHEN 1 THEN NULL ELSE 'bird' END AS n FROM r)
      SELECT doc_id FROM x WHERE coalesce(coalesce(nullif(c, ''), n) = 'animal', false) OR coalesce(TRY_CAST(confidence AS DOUBLE), 1) < 0.3""",
    "parse_label_strings": f"""WITH {PARTS}, x AS (SELECT *, p_partkey % 13 > 1 AS ok FROM p)
      SELECT p_partkey, CASE WHEN ok THEN replace(p_brand, '#', '') END AS initials, CASE WHEN ok THEN p_type END AS native, CASE WHEN ok THEN lower(p_name) END AS english, CASE WHEN ok THEN p_size / 100 END AS confidence FROM x""",
    "split_keywords": rf"""WITH {PARTS}, w AS (SELECT p_partkey, p_name, p_type, text, [CASE p_partkey % 3 WHEN 0 THEN 'bird' WHEN 1 THEN ' Unknown' ELSE 'my_birds' END, text, p_name, 'xs-小隼 ' || p_name, '_nb', p_type, CASE WHEN p_partkey % 5 = 0 THEN 'People' ELSE 'Family' END] AS ws FROM p),
      h AS (SELECT *, p_partkey % 3 = 0 OR p_partkey % 5 = 0 OR p_partkey % 13 = 1 AS has FROM w),
      m AS (SELECT *, list_filter(ws, lambda k: trim(k) IN ('bird', 'animal', 'people', 'scenery', 'People', 'Unknown', '_nb') OR regexp_matches(trim(k), '^_?.+\([0-9]{{1,3}}%\)$') OR (has AND contains(trim(k), ' ') AND NOT regexp_matches(trim(k), '^[A-Za-z]+-\s*[^-]*[\x{{4e00}}-\x{{9fff}}]'))) AS ours FROM h),
      n AS (SELECT *, list_filter(ws, lambda k: NOT list_contains(ours, k)) AS theirs FROM m),
      z AS (SELECT *, list_concat(CASE WHEN list_contains(ours, text) THEN [] ELSE ['animals|' || text] END, CASE WHEN list_contains(ours, p_type) THEN [] ELSE ['places|' || p_type] END) AS paths FROM n)
      SELECT p_partkey, array_to_string(ours, ';') AS ours, array_to_string(theirs, ';') AS theirs, array_to_string(list_concat(theirs, list_filter(['bird', p_type], lambda k: NOT list_contains(theirs, k))), ';') AS merged,
      array_to_string(list_concat(paths, list_filter(['birds|' || p_name], lambda k: NOT list_contains(paths, k))), ';') AS paths FROM z""",
    "prior_labels": rf"""WITH {PARTS}, w AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'bird' WHEN 1 THEN 'Unknown' END AS c, p_name, text FROM p)
      SELECT p_partkey, coalesce(c, CASE WHEN text = 'bird' THEN 'bird' END, '') AS category, concat_ws(';', CASE WHEN c IS NOT NULL OR text = 'bird' THEN CASE WHEN contains(p_name, ' ') THEN p_name END END,
        CASE WHEN text <> coalesce(c, CASE WHEN text = 'bird' THEN 'bird' END, '') AND (text IN ('bird') OR regexp_matches(text, '\([0-9]+%\)$') OR ((c IS NOT NULL OR text = 'bird') AND contains(text, ' '))) THEN text END, '_nb') AS label FROM w""",
    "effective_keyword": f"""WITH {LABELS}, w AS (SELECT *, CASE WHEN doc_id % 4 = 1 THEN 'xs-小隼-' ELSE '' END AS front, round_even((doc_id % 100) / 100 * 100, 0) AS pct FROM r)
      SELECT doc_id, CASE WHEN applied = 'kept-existing' AND prior_category <> '' THEN CASE WHEN doc_id % 5 <> 0 THEN 'xx-yy-' || source || ' bird(' || (doc_id % 101) || '%)' END
        WHEN label IS NULL OR confidence = 'n/a' THEN NULL ELSE front || lower(label) || '(' || CAST(pct AS INTEGER) || '%)' END AS keyword FROM w""",
    "pinyin_labels": """WITH n(i, initials) AS (VALUES (0, 'mq'), (1, 'bl'), (2, 'yhcwsq'), (3, 'xpt'), (4, 'great h'), (5, ''), (6, 'xyn'), (7, 'e'), (8, 'z')),
      p AS (SELECT p_partkey, lower(p_brand) AS brand, p_partkey % 9 AS i, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 801) / CAST(800 AS DOUBLE) ELSE (p_partkey % 397) / CAST(4 AS DOUBLE) + 1.125 END AS c FROM part)
      SELECT p_partkey, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE (CASE WHEN p_partkey % 23 = 1 THEN brand || 'mq' ELSE initials END) || ' (' || printf('%.2f', CASE WHEN c <= 1 THEN c * 100 ELSE c END) || '%)' END AS label FROM p JOIN n USING (i)""",
    "sidecar_scrub": r"""WITH p AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k, p_partkey % 3 = 0 AS serial, p_partkey % 4 = 0 AS rated, p_name,
        '<x:xmpmeta xmlns:x="adobe:ns:meta/">' || chr(10) || ' <rdf:Description rdf:about=""' AS head, chr(10) || '   ' AS gap FROM part),
      q AS (SELECT *, gap || 'xmpMM:DocumentID="d' || k || '">' || chr(10) AS id, '  <dc:subject>' || p_name || '</dc:subject>' || chr(10) || ' </rdf:Description>' || chr(10) || '</x:xmpmeta>' AS tail FROM p)
      SELECT p_partkey, head || gap || 'crs:Exposure2012="+0.10"' || id || '  <crs:ToneCurve>' || gap || '<rdf:li>0, 0</rdf:li>' || chr(10) || '  </crs:ToneCurve>' || chr(10) || tail AS scrubbed,
        CASE WHEN serial THEN 'aux:SerialNumber,' ELSE '' END || 'tiff:Make' || CASE WHEN rated THEN ',xmp:Rating' ELSE '' END AS removed, head || id || tail AS minimal FROM q""",
    "format_label": """WITH x AS (SELECT *, floor((s_acctbal + 1000) / 30) / 400 AS c FROM supplier), y AS (SELECT *, '(' || CAST(round_even(c * 100, 0) AS INTEGER) || '%)' AS pct FROM x)
      SELECT s_suppkey, CASE WHEN c <= 0.2 THEN '_' ELSE '' END || CASE WHEN s_suppkey % 3 < 2 AND s_suppkey % 4 <> 0 THEN 'c-cn-' ELSE '' END || lower(s_name) || pct AS label,
      CASE WHEN s_nationkey = 0 THEN '-' ELSE printf('%.2f', s_suppkey * 100 / s_nationkey) || '%' END AS share, 'sp-' || substr(sha256(s_name), 1, 4) AS digest FROM y""",
    "frame_identity": r"""WITH x AS (SELECT p_partkey, p_partkey AS k, lpad(CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 11 = 0 THEN 3 ELSE 5 END, '0') AS num, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'D' || (p_partkey % 9) || 'S' END AS code FROM part),
      y AS (SELECT *, CASE WHEN k % 3 = 0 THEN '20190501-' ELSE '' END || CASE WHEN k % 4 = 0 THEN '_' ELSE '' END || code || num AS body, CASE k % 7 WHEN 0 THEN '-2' WHEN 1 THEN '-Enhanced-NR' WHEN 2 THEN '-Pano-3' WHEN 3 THEN '_host_1_Conflict' ELSE '' END AS tail FROM x),
      z AS (SELECT *, regexp_matches(body || tail, '^([0-9]{8}-)?_?[A-Za-z0-9_]*[0-9]{4,}(-[0-9]+)?(_.*)?$') AS frame,
        -- without four digits behind the code, the date is what is left: its digits count, the rest is a copy's number
        len(num) < 4 AS short FROM y)
      SELECT p_partkey, body || tail AS stem, CASE WHEN NOT frame THEN NULL WHEN short THEN '' ELSE code END AS code, CASE WHEN NOT frame THEN NULL WHEN short THEN '20190501' ELSE num END AS num,
      body || CASE WHEN k % 7 IN (0, 3) THEN tail ELSE '' END AS sidecar, k % 7 IN (0, 2) OR (k % 7 > 3 AND k % 3 = 0 AND k % 5 = 0 AND k % 4 <> 0) AS is_copy FROM z""",
    "trip_dates": f"WITH {TRIPS} SELECT o_orderkey, trip, CAST(d AS VARCHAR) AS date, prec AS precision, days_off, strftime(captured, '%Y-%m-%d') || 'T10:11:12' AS taken FROM q",
    "misfiled": f"""WITH {TRIPS}, u AS (SELECT *, days_off > 2 AS off FROM q WHERE days_off IS NOT NULL), g AS (SELECT trip, count(*) AS n, count(*) FILTER (off) AS outliers, min(captured) AS first, max(captured) AS last FROM u GROUP BY trip)
      SELECT 'trip' AS kind, trip, NULL AS key, outliers, CAST(first AS VARCHAR) AS first, CAST(last AS VARCHAR) AS last FROM g WHERE outliers * 2 > n UNION ALL SELECT 'stray', trip, o_orderkey, 1, CAST(captured AS VARCHAR), CAST(captured AS VARCHAR) FROM u JOIN g USING (trip) WHERE off AND outliers * 2 <= n""",
    "vlm_response_parse": """WITH x AS (SELECT *, event_id % 5 IN (0, 3, 4) AS ok, event_id % 4 = 0 AS han FROM events)
      SELECT event_id, CASE WHEN ok THEN 'bird' ELSE 'scenery' END AS category, CASE WHEN ok AND NOT han THEN event_type ELSE 'unknown' END AS label, CASE WHEN ok AND han THEN '麻雀' ELSE '' END AS label_cn, CASE WHEN ok THEN (event_id % 100) / 100 ELSE 0 END AS confidence, '' AS note FROM x""",
    "claim_longest_prefix": f"WITH {TREES} SELECT folder, stem, base, base IS NOT NULL AND row_number() OVER (PARTITION BY folder, base ORDER BY stem) = 1 AS owns FROM claim",
    "unreached_sidecars": f"WITH {TREES} SELECT folder, stem FROM side WHERE (folder, stem) NOT IN (SELECT (folder, base) FROM claim WHERE base IS NOT NULL)",
    "sidecar_resolve": f"""WITH {TREES}, open AS (SELECT * FROM side s WHERE NOT EXISTS (FROM img i WHERE i.folder = s.folder AND i.stem = s.stem)), free AS (SELECT * FROM img i WHERE NOT EXISTS (FROM side s WHERE i.folder = s.folder AND i.stem = s.stem)),
      won AS (SELECT folder, base AS stem, count(*) AS n FROM (SELECT f.folder, o.stem AS base, row_number() OVER (PARTITION BY f.folder, f.stem ORDER BY len(o.stem) DESC) AS k FROM free f JOIN open o ON f.folder = o.folder AND starts_with(f.stem, o.stem || '-')) WHERE k = 1 GROUP BY ALL)
      SELECT s.folder, s.stem, CASE WHEN i.stem IS NOT NULL THEN 'ok' WHEN n IS NOT NULL THEN 'derived' WHEN s.folder IN (SELECT folder FROM img) THEN 'no_jpg' ELSE 'no_folder' END AS verdict, CASE WHEN i.stem IS NOT NULL THEN 1 ELSE coalesce(n, 0) END AS n_images
      FROM side s LEFT JOIN img i ON s.folder = i.folder AND s.stem = i.stem LEFT JOIN won ON won.folder = s.folder AND won.stem = s.stem""",
    "extra_images": f"""WITH {TREES}, open AS (FROM side EXCEPT FROM img), free AS (FROM img EXCEPT FROM side), taken AS (SELECT f.* FROM free f SEMI JOIN open o ON f.folder = o.folder AND starts_with(f.stem, o.stem || '-'))
      SELECT c.folder, c.stem, CASE WHEN c.base IS NULL THEN 'orphan' ELSE 'derived' END AS kind, c.base AS parent FROM claim c SEMI JOIN free f ON c.folder = f.folder AND c.stem = f.stem ANTI JOIN taken t ON c.folder = t.folder AND c.stem = t.stem""",
    "multi_claim": f"WITH {TREES} SELECT folder, base, count(*) AS claimants, min(stem) AS keeper, bool_or(stem = base) AS exact_match_wins FROM claim WHERE base IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "tree_differences": f"WITH {TREES} SELECT *, 'left' AS side FROM (FROM img EXCEPT FROM side) UNION ALL SELECT *, 'right' FROM (FROM side EXCEPT FROM img)",
    "capture_dedup": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY CASE WHEN doc_id % 19 = 0 THEN CAST(doc_id AS VARCHAR) ELSE md5(text) END",
    "duplicate_groups": """WITH x AS (SELECT doc_id AS key, source, doc_id % 4 = 0 AS copy, CASE WHEN doc_id % 6 <> 0 THEN doc_id % 9 END AS off, text FROM documents WHERE text IS NOT NULL), g AS (SELECT text, count(*) AS group_size, count(DISTINCT source) AS s, bool_or(copy) AS c FROM x GROUP BY text HAVING count(*) > 1),
      y AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY copy, coalesce(off, 1000000), key) AS rank FROM x JOIN g USING (text))
      SELECT key, CASE WHEN s > 1 THEN 'cross-trip' WHEN c THEN 'virtual-copy' ELSE 'within-trip' END AS kind, CASE WHEN rank = 1 THEN 'keep' ELSE 'duplicate' END AS role, rank, group_size FROM y""",
    "overlay_merge": """SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 AND o_orderkey % 30 <> 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority,
      CASE WHEN o_orderkey % 10 <> 0 OR o_orderkey % 30 = 0 THEN 'kept' WHEN o_orderkey % 20 = 0 THEN 'changed' ELSE 'replaced' END AS outcome FROM orders
      UNION ALL SELECT o_orderkey + 100000000, CASE WHEN o_orderkey % 20 = 0 THEN 'X' ELSE o_orderstatus END, o_orderpriority, 'appended' FROM orders WHERE o_orderkey % 30 = 0""",
    "stale_twin_buckets": """WITH k AS (SELECT doc_id AS key, text, CASE WHEN quality IS NOT NULL THEN upper(lang) END AS kept, CASE WHEN doc_id % 3 = 0 THEN 'other' WHEN doc_id % 5 = 0 THEN 'none' ELSE lang END AS label FROM documents LEFT JOIN labels USING (doc_id)),
      w AS (SELECT DISTINCT lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1), z AS (SELECT key, kept, label, (SELECT min(t.key) FROM k t WHERE t.text = k.text AND t.key <> k.key AND lower(t.label) = lower(k.kept)) AS twin FROM k WHERE kept IS NOT NULL)
      SELECT *, CASE WHEN twin IS NOT NULL THEN 'A' WHEN label IN (FROM w) THEN 'B' ELSE 'C' END AS bucket FROM z""",
    "decisions": """WITH r AS (SELECT doc_id AS key, CASE WHEN toxic = 1 THEN 'A' WHEN quality = 0 THEN 'B' ELSE 'C' END AS bucket FROM labels)
      SELECT key, bucket, CASE WHEN bucket = 'C' AND key % 4 = 0 THEN CASE WHEN key % 8 = 0 THEN 'take' ELSE 'keep' END WHEN key % 7 = 0 THEN 'keep' WHEN bucket = 'A' THEN 'take' ELSE 'keep' END AS decision FROM r""",
    "tree_compare": r"""WITH x AS (SELECT doc_id AS path, text, CASE WHEN doc_id % 3 = 0 THEN '!' || text WHEN doc_id % 7 = 0 THEN text || chr(10) || regexp_split_to_array(text, '[ \n\t]+')[1] ELSE text END AS other FROM documents)
      SELECT path, CASE WHEN path % 5 = 0 THEN 'not-in-reference' WHEN text IS NOT DISTINCT FROM other THEN 'identical'
        WHEN list_sort(list_distinct(regexp_split_to_array(text, '[ \n\t]+'))) = list_sort(list_distinct(regexp_split_to_array(other, '[ \n\t]+'))) THEN 'keywords-intact-other-differs' ELSE 'keywords-differ' END AS status FROM x""",
    "run_intersection": "SELECT vec_id FROM embeddings WHERE vec_id % 6 = 0 AND vec_id % 5 <> 0 GROUP BY vec_id",
    "knn_1nn": f"WITH {V}, {NN} SELECT key, other AS nearest, round(cosine, 6) AS cosine FROM nn",
    "knn_score": f"""WITH {V}, {NN}, b AS (SELECT a.cluster, count(*) AS n, sum(CAST(a.cluster = b.cluster AS INTEGER)) AS h FROM nn JOIN v a ON a.key = nn.key JOIN v b ON b.key = nn.other GROUP BY a.cluster)
      SELECT CAST(sum(n) AS BIGINT) AS vectors, CAST(sum(h) AS BIGINT) AS hits, round(sum(h) / sum(n), 6) AS micro, count(*) FILTER (n >= 20) AS frequent_labels, round(avg(h / n) FILTER (n >= 20), 6) AS macro_frequent, round(sum(h) FILTER (n >= 20) / sum(n) FILTER (n >= 20), 6) AS micro_frequent, count(*) FILTER (n = 1) AS singletons FROM b""",
    "quality_delta": """WITH e AS (SELECT vec_id AS key, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), a AS (SELECT x.label, arg_min(y.label, (-round(list_cosine_similarity(x.v, y.v), 12), y.key)) AS f, arg_min(y.label, (-round(list_cosine_similarity(x.v[1:32], y.v[1:32]), 12), y.key)) AS g FROM e x JOIN e y ON x.key <> y.key GROUP BY x.key, x.label)
      SELECT label, count(*) AS n, round(avg(CAST(label = f AS INTEGER)), 6) AS after, round(avg(CAST(label = g AS INTEGER)), 6) AS before, round(round(avg(CAST(label = f AS INTEGER)), 6) - round(avg(CAST(label = g AS INTEGER)), 6), 6) AS delta FROM a GROUP BY label HAVING count(*) >= 20""",
    "pair_similarity_stats": f"WITH {V}, p AS (SELECT a.cluster = b.cluster AS same, list_inner_product(a.v, b.v) AS c FROM v a JOIN v b ON a.key < b.key) SELECT count(*) FILTER (same) AS same_pairs, round(avg(c) FILTER (same), 6) AS same_cosine, count(*) FILTER (NOT same) AS different_pairs, round(avg(c) FILTER (NOT same), 6) AS different_cosine FROM p",
    "unit_norms": f"WITH {V} SELECT cluster, count(*) AS n, round(max(abs(sqrt(list_inner_product(v, v)) - 1)), 5) AS worst FROM v GROUP BY cluster",
    "tile_matrix": f"""WITH {V}, {ORDERED}, n AS (SELECT count(*) AS n FROM v), t AS (SELECT least(CAST(floor((position - 1) * 12 / (SELECT n FROM n)) AS BIGINT), 11) AS tile, v FROM o)
      SELECT a.tile AS tile_a, b.tile AS tile_b, round(avg(list_inner_product(a.v, b.v)), 6) AS mean_similarity FROM t a JOIN t b ON a.tile <= b.tile GROUP BY ALL""",
    "radius_rank": f"WITH {V}, {CENT} SELECT cluster, key, round(round(list_distance(v, centroid), 9), 6) AS radius, row_number() OVER (PARTITION BY cluster ORDER BY round(list_distance(v, centroid), 9), key) AS rank, count(*) OVER (PARTITION BY cluster) AS n FROM v JOIN cent USING (cluster)",
    "effective_dimension": f"""WITH {V}, {CENT}, r AS (SELECT cluster, round(list_distance(v, centroid), 9) AS radius, row_number() OVER (PARTITION BY cluster ORDER BY round(list_distance(v, centroid), 9), key) AS rank, count(*) OVER (PARTITION BY cluster) AS n FROM v JOIN cent USING (cluster)),
      i AS (SELECT *, rank BETWEEN greatest(1, floor(n * 0.1)) + 1 AND greatest(2, floor(n * 0.9)) AND radius > 0 AS ok, radius / nullif(max(radius) OVER w, 0) AS x, rank / n AS y FROM r WINDOW w AS (PARTITION BY cluster)),
      a AS (SELECT *, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS part FROM i WINDOW w AS (PARTITION BY cluster ORDER BY rank))
      SELECT cluster, max(n) AS n, round(regr_slope(CASE WHEN ok THEN ln(rank / n) END, CASE WHEN ok THEN ln(radius) END), 6) AS dimension, round(sum(part), 6) AS auc, CASE WHEN round(sum(part), 6) > 0.5 THEN 'concave' ELSE 'convex' END AS shape FROM a GROUP BY cluster""",
    "adjacency_cos": f"WITH {V}, {ORDERED}, x AS (SELECT *, lead(v) OVER w AS nv, lead(cluster) OVER w AS nc FROM o WINDOW w AS (ORDER BY position)) SELECT position, key, cluster, round(1 - list_inner_product(v, nv), 6) AS gap, CAST(cluster <> nc AS INTEGER) AS boundary FROM x WHERE nv IS NOT NULL",
    "adjacency_row": f"""WITH {V}, {ORDERED}, p AS (SELECT a.position, a.key, a.cluster, CAST(a.cluster <> b.cluster AS INTEGER) AS boundary, a.v AS av, b.v AS bv FROM o a JOIN o b ON b.position = a.position + 1)
      SELECT position, p.key, p.cluster, round(sqrt(sum(power(list_inner_product(bv, v.v) - list_inner_product(av, v.v), 2))), 6) AS gap, boundary FROM p, v GROUP BY position, p.key, p.cluster, boundary""",
    "boundary_steps": f"""WITH {V}, {ORDERED}, x AS (SELECT *, lead(v) OVER w AS nv, lead(cluster) OVER w AS nc FROM o WINDOW w AS (ORDER BY position)), g AS (SELECT position, round(1 - list_inner_product(v, nv), 6) AS gap, CAST(cluster <> nc AS INTEGER) AS b FROM x WHERE nv IS NOT NULL),
      k AS (SELECT *, row_number() OVER (ORDER BY gap DESC, position) AS n FROM g) SELECT CAST(sum(b) AS BIGINT) AS boundaries, round(avg(gap) FILTER (b = 1), 6) AS at_boundaries, round(avg(gap) FILTER (b = 0), 6) AS elsewhere, CAST(sum(b) FILTER (n <= (SELECT sum(b) FROM g)) AS BIGINT) AS largest_that_are_boundaries FROM k""",
    "rolling_median": """WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS p, count(*) OVER () AS n FROM events), k AS (SELECT max(n) AS n, greatest(5, max(n) // 200) AS k FROM e),
      s AS (SELECT e.event_id, unnest(range(p - k // 2, p + k - k // 2)) AS q FROM e, k WHERE k.n > 200), v AS (SELECT s.event_id, e.value FROM s, k, e WHERE e.p = least(greatest(q, 1), k.n))
      SELECT e.event_id, round(m, 4) AS median FROM e LEFT JOIN (SELECT event_id, median(value) AS m FROM v GROUP BY event_id) USING (event_id)""",
    "timeline_rank": f"WITH {TRIPS}, d AS (SELECT DISTINCT trip AS name, d AS date FROM t) SELECT name, CAST(date AS VARCHAR) AS date, CASE WHEN date IS NULL THEN -1 ELSE row_number() OVER (PARTITION BY date IS NULL ORDER BY date, name) - 1 END AS rank FROM d",
    "timeline_neighbours": f"""WITH {TRIPS}, d AS (SELECT *, row_number() OVER (ORDER BY date, name) AS rank FROM (SELECT DISTINCT trip AS name, d AS date FROM t) WHERE date IS NOT NULL)
      SELECT a.name, b.name AS later, b.rank - a.rank AS apart, date_diff('day', a.date, b.date) AS days FROM d a JOIN d b ON b.rank - a.rank BETWEEN 1 AND 2""",
    "frame_collisions": f'WITH {FRAMES}, x AS (SELECT *, lag(pos) OVER (PARTITION BY "group", key ORDER BY pos) AS before FROM (SELECT DISTINCT "group", key, pos FROM f)) SELECT "group", key, before, pos FROM x WHERE pos - before <= 3',
    "trip_digest": f"""WITH {FRAMES}, k AS (SELECT "group", trip, key, count(*) AS n FROM f GROUP BY ALL), r AS (SELECT "group", trip, code, code || ':' || min(num) || '-' || max(num) AS x FROM f GROUP BY "group", trip, code),
      s AS (SELECT "group", trip, string_agg(x, ',' ORDER BY code) AS ranges FROM r GROUP BY "group", trip)
      SELECT k."group", k.trip, CAST(sum(n) AS BIGINT) AS files, count(*) AS keys, count(*) FILTER (n > 1) AS repeated, any_value(ranges) AS ranges FROM k JOIN s ON k."group" = s."group" AND k.trip = s.trip GROUP BY k."group", k.trip""",
    "segments": f"WITH RECURSIVE {FRAMES}, {CONFLICTS}, {WALK} SELECT * FROM seg",
    # A trip meets the envelope of all trips from q on if q is no later than one that ends high enough and one that begins low enough.
    "segments_strict": f"""WITH RECURSIVE {FRAMES}, r AS (SELECT "group", pos, code, min(num) AS low, max(num) AS high FROM f GROUP BY ALL),
      e AS (SELECT a."group", a.pos, a.code, max(b.pos) FILTER (b.high >= a.low) AS over, max(b.pos) FILTER (b.low <= a.high) AS under FROM r a LEFT JOIN r b ON a."group" = b."group" AND a.code = b.code AND b.pos < a.pos GROUP BY ALL),
      c AS (SELECT "group", pos, max(CASE WHEN over IS NOT NULL AND under IS NOT NULL THEN least(over, under) END) AS last FROM e GROUP BY ALL), {WALK} SELECT * FROM seg""",
    "segment_verify": f"""WITH RECURSIVE {FRAMES}, {CONFLICTS}, {WALK}, k AS (SELECT f."group", segment, key, count(*) AS n, count(DISTINCT f.pos) AS t, min(f.pos) AS a, max(f.pos) AS b FROM f JOIN seg ON f."group" = seg."group" AND f.pos = seg.pos GROUP BY ALL)
      SELECT "group", segment, min(a) AS first_pos, max(b) AS last_pos, CAST(sum(n) AS BIGINT) AS files, count(*) AS keys, count(*) FILTER (t > 1) AS crossing FROM k GROUP BY ALL""",
    "date_slots": f"WITH {USERS}, d AS (SELECT *, greatest(1, CAST(ceil(size / 24) AS BIGINT)) AS days FROM u) SELECT position, size, days, CAST(coalesce(sum(days) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_day FROM d",
    "next_fit": f"""WITH RECURSIVE {USERS}, w AS (SELECT position, size, CAST(1 AS BIGINT) AS bin, CAST(0 AS BIGINT) AS "offset", CAST(1 + size // 60 AS BIGINT) AS day, CAST(size % 60 AS BIGINT) AS used FROM u WHERE position = 1
      UNION ALL SELECT position, size, d, o, d + (o + size) // 60, (o + size) % 60 FROM (SELECT u.position, u.size, w.day + CAST(w.used > 0 AND w.used + u.size > 60 AS BIGINT) AS d, CASE WHEN w.used + u.size > 60 THEN 0 ELSE w.used END AS o FROM w JOIN u ON u.position = w.position + 1))
      SELECT position, size, bin, "offset", CASE WHEN position % 2 = 1 THEN 'Red' ELSE 'Blue' END AS colour FROM w""",
    "audit_rollup": "SELECT CASE WHEN grouping(y) = 1 THEN '(all)' ELSE y END AS year, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (starts_with(o_orderpriority, '1')) AS urgent, round(sum(o_totalprice), 2) AS total FROM (SELECT *, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders) GROUP BY ROLLUP (y)",
    "species_tail": "SELECT count(*) AS names, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n >= 5) AS at_least_5, count(*) FILTER (n >= 20) AS at_least_20, count(*) FILTER (n >= 50) AS at_least_50, count(*) FILTER (n >= 100) AS at_least_100 FROM (SELECT count(*) AS n FROM part GROUP BY p_name)",
    "species_top": "SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 30",
    "species_vocabulary": f"WITH {LABELS} SELECT DISTINCT CASE WHEN doc_id % 5 = 0 THEN 'no label' ELSE lower(source) || ' bird' END AS name FROM r WHERE lower(trim(category)) = 'bird' OR prior_category = 'bird'",
    "anonymise_digest": "SELECT p_partkey, 'sp-' || substr(sha256(p_name), 1, 4) AS tag FROM part",
    "mark_state": "WITH x AS (SELECT n_nationkey, CAST(n_nationkey * 3 % 32 AS INTEGER) AS s FROM nation) SELECT n_nationkey, 'C_' || to_hex(s) AS mark, s AS state, s & 3 = 3 AS ready, 'C_' || to_hex(s | 4) AS next_mark, s & ~7 AS unknown FROM x",
    "report_parse": r"""WITH x AS (SELECT *, last_value(CASE WHEN role = 'user' THEN 'reason ' || (turn % 4) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS reason FROM conversations),
      y AS (SELECT conv_id, turn AS pos, reason, 'a' || (turn % 3) || CASE WHEN conv_id % 2 = 0 THEN '-Enhanced-NR' ELSE '' END || '.xmp' AS name, 'a' || (turn % 3) AS stem FROM x WHERE role <> 'user' AND reason IS NOT NULL)
      SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY conv_id, stem ORDER BY pos) = 1""",
    "flat_export_decode": """WITH n AS (SELECT page_id, '20' || lpad(CAST(page_id % 25 AS VARCHAR), 2, '0') || CASE WHEN page_id % 4 = 0 THEN 'x' ELSE '-06 trip' END AS trip, page_id || '.jpg' AS file FROM pages WHERE page_id % 9 <> 0)
      SELECT trip || '~~' || file AS name, CASE WHEN trip LIKE '%5-06%' THEN 'Photos-99' WHEN page_id % 4 <> 0 THEN 'Photos-' || substr(trip, 3, 2) END AS library, trip, file FROM n""",
    "incremental_upsert": "SELECT user_id, max(event_id) AS event_id, arg_max(ts, event_id) AS ts, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, count(*) AS versions FROM events GROUP BY user_id",
}
# Findings are the first match of each kind in each line.
ORACLE_SQL["pii_scan"] = r"""
WITH d AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS a FROM documents),
l AS (SELECT * FROM (SELECT doc_id, unnest(a) AS t, unnest(range(1, len(a) + 1)) AS line FROM d) WHERE NOT starts_with(t, 'Generated by ') AND NOT starts_with(t, 'No timestamp:')),
n AS (SELECT DISTINCT lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) AS name FROM benchmark)
SELECT doc_id, CAST(line AS INTEGER) AS line, 'photographer''s name' AS kind, 'Maria' AS found FROM l WHERE contains(lower(t), 'maria')
UNION ALL SELECT doc_id, CAST(line AS INTEGER), 'species name', min(name) FROM l JOIN n ON contains(lower(t), name) WHERE len(name) BETWEEN 4 AND 59 GROUP BY ALL
UNION ALL """ + " UNION ALL ".join(
    rf"SELECT doc_id, CAST(line AS INTEGER) AS line, '{kind}' AS kind, regexp_extract(t, '{pattern}', 0) AS found FROM l WHERE regexp_matches(t, '{pattern}')"
    for kind, pattern in {
        "trip folder name": r"\b(?:19|20)\d{2}-\d{2}-\d{2}(?:[~-]\d{2})?\s+[A-Z\x{4e00}-\x{9fff}]\S*",
        "image key or path": r"(?i)\bPhotos-\d{2}\b|\b\w[\w-]*\.(?:jpg|jpeg|xmp|nef|arw|cr3|dng)\b",
        "GPS": r"\b\d{1,3},\d{1,2}\.\d+[NSEW]\b|\bGPS(?:Latitude|Longitude)\b|\b-?\d{1,3}\.\d{4,}\s*,\s*-?\d{1,3}\.\d{4,}\b",
        "camera serial": r"(?i)\b(?:BodySerialNumber|SerialNumber|serial)\b\W{0,3}([\w-]{4,})",
        "home directory path": r"""/home/[^/\s`\"'']+|/Users/[^/\s`\"'']+""",
        "CJK text": r"[\x{4e00}-\x{9fff}]+",
    }.items()
)

RESOLVED = f"""{TREES}, free AS (SELECT i.* FROM img i ANTI JOIN side s ON i.folder = s.folder AND i.stem = s.stem),
  open AS (SELECT s.* FROM side s ANTI JOIN img i ON i.folder = s.folder AND i.stem = s.stem),
  taken AS (SELECT DISTINCT folder, base AS stem FROM (SELECT f.folder, f.stem, o.stem AS base, row_number() OVER (PARTITION BY f.folder, f.stem ORDER BY len(o.stem) DESC) AS n FROM free f JOIN open o ON f.folder = o.folder AND (f.stem = o.stem OR starts_with(f.stem, o.stem || '-'))) WHERE n = 1),
  lost AS (SELECT o.folder, o.stem, CASE WHEN o.folder IN (SELECT folder FROM img) THEN 'no_jpg' ELSE 'no_folder' END AS verdict FROM open o ANTI JOIN taken t ON o.folder = t.folder AND o.stem = t.stem)"""
ORACLE_SQL |= {
    "folder_differences": f"WITH {TREES} SELECT DISTINCT folder, 'orphan' AS kind FROM img WHERE folder NOT IN (SELECT folder FROM side) UNION ALL SELECT DISTINCT folder, 'unexported' FROM side WHERE folder NOT IN (SELECT folder FROM img)",
    "missing_sidecars": f"""WITH {RESOLVED}, e AS (SELECT folder, base AS stem, arg_min('reason ' || (k % 3), k) AS reason, arg_min(base || '.nef', k) AS name FROM b WHERE k % 4 < 2 GROUP BY ALL)
      SELECT coalesce(e.reason, '(not mentioned by the exporter)') AS reason, verdict, lost.folder, lost.stem, coalesce(e.name, '') AS raw_name FROM lost LEFT JOIN e ON lost.folder = e.folder AND lost.stem = e.stem""",
    "existing_images": f"WITH {TREES} SELECT s.folder, s.stem, (SELECT count(*) FROM side x ANTI JOIN img i ON x.folder = i.folder AND x.stem = i.stem) AS missing FROM side s SEMI JOIN img i ON s.folder = i.folder AND s.stem = i.stem",
    "apply_decisions": "SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 AND toxic = 1 THEN 'written' WHEN quality = 1 THEN 'kept-existing' ELSE 'csv-only' END AS applied FROM labels",
    "bucket_counts": f"SELECT bucket, decision, count(*) AS n FROM ({ORACLE_SQL['decisions']}) GROUP BY bucket, decision",
    "capture_groups": """WITH x AS (SELECT l_orderkey || '-' || l_linenumber AS key, CASE WHEN l_orderkey % 40 = 0 THEN 'odid|id' || (l_partkey % 50) WHEN l_orderkey % 40 = 1 THEN NULL
        WHEN l_orderkey % 40 < 20 THEN 'time+frame|' || strftime(l_shipdate, '%Y-%m-%d') || '|' || l_returnflag || '|' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') ELSE 'time+name|' || strftime(l_shipdate, '%Y-%m-%d') || '|' || l_linestatus END AS capture FROM lineitem)
      SELECT capture, count(*) AS n, min(key) AS first FROM x WHERE capture IS NOT NULL GROUP BY capture HAVING count(*) > 1""",
    "density_peaks": f"""WITH {V}, {ORDERED}, p AS (SELECT cluster, key, position, round(1 - abs(v[1] - 0.1), 2) AS probability FROM o)
      SELECT cluster, arg_max(key, (probability, -position)) AS density_peak, round(avg(probability), 6) AS mean_probability FROM p GROUP BY cluster""",
    "label_spans": """WITH x AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS p, o_orderstatus AS c FROM orders), y AS (SELECT *, p - row_number() OVER (PARTITION BY c ORDER BY p) AS g FROM x)
      SELECT min(p) AS "begin", max(p) + 1 AS "end", c AS cluster FROM y GROUP BY c, g""",
    "adjusted_mutual_information": """WITH d AS (SELECT source AS c, lang AS l FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL), t AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM d),
      m AS (SELECT c, l, count(*) AS n FROM d GROUP BY ALL), a AS (SELECT c, CAST(count(*) AS DOUBLE) AS a FROM d GROUP BY c), b AS (SELECT l, CAST(count(*) AS DOUBLE) AS b FROM d GROUP BY l),
      i AS (SELECT sum(n / t * ln(n * t / (a * b))) AS mi FROM m JOIN a USING (c) JOIN b USING (l), t),
      s AS (SELECT a, b, t, unnest(range(CAST(greatest(1, a + b - t) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS n FROM a, b, t),
      e AS (SELECT sum(n / t * ln(n * t / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(n + 1) - lgamma(a - n + 1) - lgamma(b - n + 1) - lgamma(t - a - b + n + 1))) AS e FROM s),
      h AS (SELECT (SELECT -sum(a / t * ln(a / t)) FROM a, t) AS ha, (SELECT -sum(b / t * ln(b / t)) FROM b, t) AS hb)
      SELECT round((mi - e) / ((ha + hb) / 2 - e), 6) AS ami, round(mi, 6) AS mutual_information FROM i, e, h""",
    "top_movers": """WITH d AS (SELECT p_brand AS label, round(avg(p_retailprice) FILTER (p_partkey % 2 = 0) - avg(p_retailprice) FILTER (p_partkey % 2 = 1), 4) AS delta FROM part GROUP BY p_brand),
      x AS (SELECT *, CASE WHEN delta > 0 THEN 'improved' ELSE 'degraded' END AS kind FROM d WHERE delta <> 0) SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(delta) DESC, label) AS rank FROM x QUALIFY rank <= 5""",
    "warped_tiles": """WITH n AS (SELECT count(*) AS n FROM embeddings), w AS (SELECT DISTINCT least(CAST(round_even(n * sqrt(k / 24), 0) AS BIGINT), n) AS start, n FROM n, range(0, 25) r(k)),
      c AS (SELECT label, count(*) AS size, sum(count(*)) OVER (ORDER BY label) - count(*) + 1 AS b, sum(sqrt(count(*))) OVER () AS total FROM embeddings GROUP BY label),
      p AS (SELECT *, greatest(1, least(CAST(round_even(sqrt(size) / total * 24, 0) AS BIGINT), size)) AS per FROM c), q AS (SELECT b, size, per, unnest(range(0, per)) AS i FROM p)
      SELECT 'warp' AS kind, start FROM w WHERE start < n UNION ALL SELECT 'cluster', CAST(b + i * size // per AS BIGINT) FROM q""",
    "label_attach": "SELECT o_orderkey AS key, (SELECT arg_max(l_returnflag, (l_linenumber, l_partkey, l_returnflag)) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber > 2) AS label FROM orders",
    "vector_fingerprints": """SELECT 'm' || (label % 2) || '@' || CASE WHEN vec_id % 7 < 2 OR vec_id % 3 = 0 THEN '(unrecorded)' ELSE CAST(vec_id % 3 * 224 AS VARCHAR) END AS fingerprint, count(*) AS n FROM embeddings GROUP BY 1""",
}
# The rank sum of held-out scores along the difference of the other half's means, for pairs of the three largest labels.
ORACLE_SQL["direction_auc"] = f"""WITH {V}, top AS (SELECT cluster FROM v GROUP BY cluster ORDER BY count(*) DESC, cluster LIMIT 3), p AS (SELECT a.cluster AS first, b.cluster AS second FROM top a JOIN top b ON a.cluster < b.cluster),
  m AS (SELECT cluster, list(x ORDER BY i) AS mean FROM (SELECT cluster, i, avg(x) AS x FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM v WHERE key % 2 = 0) GROUP BY ALL) GROUP BY cluster),
  s AS (SELECT first, second, v.cluster = first AS is_first, round(list_inner_product(v.v, list_transform(range(1, len(a.mean) + 1), lambda i: a.mean[i] - b.mean[i])), 9) AS score FROM p JOIN m a ON a.cluster = first JOIN m b ON b.cluster = second JOIN v ON v.cluster IN (first, second) WHERE key % 2 = 1),
  r AS (SELECT *, rank() OVER (PARTITION BY first, second ORDER BY score) + (count(*) OVER (PARTITION BY first, second, score) - 1) / 2 AS rank FROM s)
  SELECT first, second, count(*) FILTER (is_first) AS n_first, count(*) FILTER (NOT is_first) AS n_second, round((sum(rank) FILTER (is_first) - count(*) FILTER (is_first) * (count(*) FILTER (is_first) + 1) / 2) / (count(*) FILTER (is_first) * count(*) FILTER (NOT is_first)), 6) AS auc FROM r GROUP BY first, second"""
SESSIONS = """o AS (SELECT *, ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL AS begins FROM events WHERE ts IS NOT NULL),
  n AS (SELECT *, sum(begins::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o),
  sessions AS (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS events, round(sum(value), 2) AS total FROM n GROUP BY user_id, s)"""
ORACLE_SQL |= {
    "event_windows": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "event_sessions": f"WITH {SESSIONS} FROM sessions",
    "event_session_stream": f"WITH {SESSIONS} FROM sessions WHERE session_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "pending_items": "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
    "frequent_names": "SELECT p_partkey, split_part(p_name, ' ', 1) AS word FROM part QUALIFY count(*) OVER (PARTITION BY split_part(p_name, ' ', 1)) >= 20",
    "model_answers": """SELECT doc_id, CASE WHEN ok THEN CAST(length(coalesce(text, '')) AS INTEGER) END AS n_chars, CASE WHEN ok THEN CASE WHEN length(coalesce(text, '')) > 500 THEN 'long' ELSE 'short' END END AS label, 1 AS attempts, CASE WHEN NOT ok THEN 'Refused: no answer' END AS error
      FROM (SELECT *, doc_id % 97 <> 0 AS ok FROM documents)""",
    "marked_order": "SELECT doc_id, source, source_size, row_number() OVER (ORDER BY source_size DESC, source NULLS FIRST, doc_id) AS place, '' AS \"C_3\" FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS source_size FROM documents)",
}
ORACLE_SQL |= {
    "unprocessed_worklist": f"""WITH {RESOLVED}, given AS (SELECT folder, base AS stem FROM (SELECT f.folder, f.stem, o.stem AS base, row_number() OVER (PARTITION BY f.folder, f.stem ORDER BY len(o.stem) DESC) AS n FROM free f JOIN open o ON f.folder = o.folder AND starts_with(f.stem, o.stem || '-')) WHERE n = 1), v AS (SELECT folder, stem, 'ok' AS verdict, CAST(1 AS BIGINT) AS copies FROM (FROM side INTERSECT FROM img)
      UNION ALL SELECT folder, stem, 'derived', count(*) FROM given GROUP BY ALL UNION ALL SELECT folder, stem, verdict, 0 FROM lost),
      k AS (SELECT *, len(stem) + len(folder) AS n FROM v)
      SELECT copies > 0 AS jpg_available, CASE n % 3 WHEN 0 THEN 'no keywords' ELSE 'keywords but no category' END AS reason, folder, stem, verdict, copies FROM k WHERE n % 11 <> 0 AND n % 3 < 2""",
    "segment_cuts": f"""WITH RECURSIVE {FRAMES}, {CONFLICTS}, {WALK}, h AS (SELECT DISTINCT f."group", f.pos, f.key, segment FROM f JOIN seg ON f."group" = seg."group" AND f.pos = seg.pos)
      SELECT a."group", a.segment, a.pos, a.key, min(b.pos) AS owner FROM h a JOIN h b ON a."group" = b."group" AND a.segment = b.segment + 1 AND a.key = b.key
      WHERE a.pos = (SELECT min(pos) FROM seg WHERE seg."group" = a."group" AND seg.segment = a.segment) GROUP BY ALL""",
    "date_plan": """WITH u AS (SELECT user_id, count(*) AS size, row_number() OVER (ORDER BY user_id) AS position FROM events GROUP BY user_id),
      d AS (SELECT user_id, position, CAST(coalesce(sum(greatest(1, CAST(ceil(size / 24) AS BIGINT))) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_day FROM u),
      e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events)
      SELECT event_id, position, rank, first_day + (rank - 1) // 24 AS day, CAST((rank - 1) % 24 AS INTEGER) AS minute FROM e JOIN d USING (user_id)""",
    "duplicate_agreement": """WITH g AS (SELECT text, count(DISTINCT coalesce(lang, '-')) = 1 AS l, count(DISTINCT coalesce(source, '-')) = 1 AS s FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)
      SELECT count(*) AS captures, count(*) FILTER (l) AS same_lang, round(count(*) FILTER (l) / count(*), 6) AS share_lang, count(*) FILTER (s) AS same_source, round(count(*) FILTER (s) / count(*), 6) AS share_source FROM g""",
}
