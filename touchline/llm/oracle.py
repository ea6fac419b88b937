"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

ORACLE = {
    "op1_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), firsts AS (
    SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
    GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
    SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.first_doc AS gone
    FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])
        END) AS shingle
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach(doc_id, root) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id
)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.root) AS component_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
""",
    "op12_decontamination": r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents
), item AS (
    SELECT item_id, ws, least(len(ws), 10) AS size FROM (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
        FROM benchmark)
    WHERE len(ws) > 0
), windows AS (
    SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS w
    FROM (SELECT item_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM item)
), places AS (
    SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
    FROM doc, (SELECT DISTINCT size FROM windows) WHERE len(ws) >= size
), hits AS (
    SELECT p.doc_id, p.i, p.size, w.item_id
    FROM (SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS w FROM places) p JOIN windows w ON p.w = w.w AND p.size = w.size
), covered AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM doc d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
""",
    "op13_filter_audit": r"""
WITH firsts AS (
    SELECT coalesce(text, '') AS t, min(doc_id) AS first_id FROM documents GROUP BY 1
), base AS (
    SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS t,
           list_filter(regexp_split_to_array(coalesce(d.text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws, f.first_id
    FROM documents d JOIN firsts f ON coalesce(d.text, '') = f.t
), marks AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), fails AS (
    SELECT b.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
           len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
           100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t) AS c,
           regexp_matches(t, '[#$%&*|]') AS d, b.doc_id > b.first_id AS e
    FROM base b LEFT JOIN marks m ON m.doc_id = b.doc_id
), counted AS (
    SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM fails GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
    SELECT v.l || w.l || x.l || y.l || z.l AS filter_order
    FROM letters v, letters w, letters x, letters y, letters z
    WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5
), fate AS (
    SELECT c.*, o.filter_order,
           least(CASE WHEN a THEN instr(o.filter_order, 'A') ELSE 9 END, CASE WHEN b THEN instr(o.filter_order, 'B') ELSE 9 END,
                 CASE WHEN c THEN instr(o.filter_order, 'C') ELSE 9 END, CASE WHEN d THEN instr(o.filter_order, 'D') ELSE 9 END,
                 CASE WHEN e THEN instr(o.filter_order, 'E') ELSE 9 END) AS gone
    FROM counted c, orders o
), steps AS (
    SELECT f.*, s.step, substr(f.filter_order, s.step, 1) AS letter,
           CASE substr(f.filter_order, s.step, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS it,
           a::INT + b::INT + c::INT + d::INT + e::INT AS failing
    FROM fate f, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
), cells AS (
    SELECT part, filter_order, step, letter,
           coalesce(sum(n) FILTER (gone > step), 0) AS kept, coalesce(sum(n) FILTER (gone = step), 0) AS removed,
           coalesce(sum(n) FILTER (it AND gone < step), 0) AS redundant, coalesce(sum(n) FILTER (it AND failing = 1), 0) AS unique_fails,
           coalesce(sum(good) FILTER (gone = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0) AS toxic_lost
    FROM steps GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM cells
""",
}
