"""The llm queries that SQL can say, written out for DuckDB."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
 win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
 twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win),
 rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 8)) AS j) WHERE c > 1 GROUP BY 1),
 s AS (SELECT d.r, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
   len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_capitals FROM d LEFT JOIN rep ON rep.r = d.r),
 b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
 v AS (SELECT lang, source, m.metric, m.v FROM (SELECT lang, source, unnest([{{'metric': 'w', 'v': word_chars / n_words}}, {{'metric': 's', 'v': n_symbols / n_words}}, {{'metric': 'd', 'v': n_dup_lines / n_lines}}, {{'metric': 'c', 'v': n_capitals / word_chars}}]) AS m FROM b WHERE NOT base_failed)),
 bins AS (SELECT lang, source, metric, CASE WHEN v > 0 THEN ceil(ln(v) / ln(1.02)) ELSE -100000 END AS bin, count(*) AS n FROM v GROUP BY ALL),
 lv AS (SELECT 2 AS basis, lang, source, metric, bin, n FROM bins UNION ALL SELECT 1, lang, NULL, metric, bin, sum(n) FROM bins GROUP BY lang, metric, bin UNION ALL SELECT 0, NULL, NULL, metric, bin, sum(n) FROM bins GROUP BY metric, bin),
 rk AS (SELECT *, sum(n) OVER (PARTITION BY basis, lang, source, metric) AS total, sum(n) OVER (PARTITION BY basis, lang, source, metric ORDER BY bin) AS upto FROM lv),
 q AS (SELECT basis, lang, source, metric, max(total) AS total, min(bin) FILTER (upto >= total * 0.25) AS b1, min(bin) FILTER (upto >= total * 0.5) AS b2, min(bin) FILTER (upto >= total * 0.75) AS b3 FROM rk GROUP BY ALL),
 val AS (SELECT basis, lang, source, metric, total, CASE WHEN b1 = -100000 THEN 0 ELSE 2 * 1.02 ** b1 / 2.02 END AS q1, CASE WHEN b2 = -100000 THEN 0 ELSE 2 * 1.02 ** b2 / 2.02 END AS q2, CASE WHEN b3 = -100000 THEN 0 ELSE 2 * 1.02 ** b3 / 2.02 END AS q3 FROM q),
 fence AS (SELECT basis, lang, source, max(total) AS total, max(q2 + greatest(2.0, 4 * (q3 - q2))) FILTER (metric = 'w') AS wh, max(q2 - greatest(2.0, 4 * (q2 - q1))) FILTER (metric = 'w') AS wl, max(q2 + greatest(0.05, 4 * (q3 - q2))) FILTER (metric = 's') AS sh,
   max(q2 + greatest(0.5, 4 * (q3 - q2))) FILTER (metric = 'd') AS dh, max(q2 + greatest(0.25, 4 * (q3 - q2))) FILTER (metric = 'c') AS ch FROM val GROUP BY ALL),
 pick AS (SELECT b.*, f.wh, f.wl, f.sh, f.dh, f.ch FROM b LEFT JOIN fence f ON (f.basis = 0 OR (f.total >= 200 AND f.lang IS NOT DISTINCT FROM b.lang AND (f.basis = 1 OR f.source IS NOT DISTINCT FROM b.source))) QUALIFY row_number() OVER (PARTITION BY b.r ORDER BY f.basis DESC) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(word_chars / n_words > wh OR word_chars / n_words < wl, false) AND NOT coalesce(n_symbols / n_words > sh, false) AND NOT coalesce(n_dup_lines / n_lines > dh, false) AND NOT coalesce(n_capitals / word_chars > ch, false) AS kept FROM pick"""

OP4 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
 win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
 least_id AS (SELECT k, min(doc_id) AS m FROM win GROUP BY 1),
 gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN least_id USING (k), (SELECT unnest(range(0, 13)) AS j) WHERE m < doc_id),
 pos AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
 kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
 n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""

OP9 = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
 c AS (SELECT *, 3 * source_size / w AS ratio FROM s),
 o AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS k, ((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
       / ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM c),
 f AS (SELECT arg_min(level, k) AS final FROM o WHERE ratio > level),
 t AS (SELECT source, source_size, CASE WHEN ratio > final THEN final * w ELSE (3 * source_size)::DOUBLE END AS target FROM o, f),
 p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(size * (whole + CASE WHEN upto - size / 2 < target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p"""

OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
 both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (k) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
 link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
 edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
 reach AS (SELECT doc_id, doc_id AS seen FROM d UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.seen = edge.a),
 grp AS (SELECT doc_id, min(seen) AS class_id FROM reach GROUP BY 1),
 cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY CASE WHEN len(w) = 0 THEN [doc_id::VARCHAR, ''] ELSE w END) AS rep_id, count(*) OVER (PARTITION BY CASE WHEN len(w) = 0 THEN [doc_id::VARCHAR, ''] ELSE w END) AS copies FROM d),
 cnt AS (SELECT a AS doc_id, count(*) AS links FROM edge GROUP BY 1),
 txt AS (SELECT e.a AS doc_id, count(DISTINCT o.rep_id) AS linked_texts FROM edge e JOIN cls s ON s.doc_id = e.a JOIN cls o ON o.doc_id = e.b WHERE s.rep_id <> o.rep_id GROUP BY 1)
SELECT doc_id, rep_id, class_id, copies, coalesce(linked_texts, 0) AS linked_texts, coalesce(links, 0) AS links FROM cls JOIN grp USING (doc_id) LEFT JOIN cnt USING (doc_id) LEFT JOIN txt USING (doc_id)"""

ORACLES = {"op3_quality_rules": OP3, "op4_substring_dedup": OP4, "op9_mixing": OP9, "op10_jaccard_join": OP10}
