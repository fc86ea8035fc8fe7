"""ANSI SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

P1_FOUND = r"""
WITH known AS (
  SELECT mapping_id, arg_max(cat, coalesce(mapped_at, TIMESTAMP '0001-01-01')) AS cat FROM (
    SELECT mapping_id, mapped_at,
      split_part(upper(list_filter(list_transform(mitre_ids, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x IS NOT NULL AND x <> '')[1]), '.', 1) AS cat
    FROM mappings WHERE mapping_id IS NOT NULL) GROUP BY 1),
n AS (SELECT count(*) AS n FROM known WHERE cat IS NOT NULL),
c AS (SELECT cat, count(*) AS k FROM known WHERE cat IS NOT NULL GROUP BY 1)
SELECT technique_id FROM label_targets, n LEFT JOIN c ON c.cat = technique_id
WHERE coalesce(k, 0) < target_share * (n / 10.0) OR coalesce(k, 0) < min_rows
"""

_ALIKE = r"""
WITH known AS ({known}),
bags AS (SELECT id, side, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM known),
long AS (SELECT id, side, w, len(w) AS n FROM bags WHERE len(w) >= {least}),
flat AS (SELECT id, side, n, unnest(w) AS word FROM long),
pairs AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS shared
  FROM flat x JOIN flat y ON x.word = y.word AND x.id < y.id {side} GROUP BY x.id, y.id)
SELECT a AS {a}, b AS {b} FROM pairs WHERE shared >= 0.7 * (na + nb - shared) - 1e-9
"""

P2_FOUND = _ALIKE.format(known="SELECT finding_id AS id, 0 AS side, arg_max(coalesce(title, '') || ' ' || coalesce(description, ''), coalesce(ingested_at, TIMESTAMP '0001-01-01')) AS text FROM findings WHERE finding_id IS NOT NULL GROUP BY 1", least=20, side="", a="finding_id_a", b="finding_id_b")
P3_FOUND = _ALIKE.format(
    known="SELECT id, CASE WHEN best.s = 'train' THEN 1 ELSE 2 END AS side, best.t AS text FROM (SELECT report_id AS id, arg_max(struct_pack(s := lower(split_name), t := coalesce(technical_summary, '')), coalesce(added_at, TIMESTAMP '0001-01-01')) AS best FROM reports WHERE report_id IS NOT NULL GROUP BY 1) WHERE best.s IS NOT NULL",
    least=10, side="AND x.side <> y.side", a="report_id_a", b="report_id_b",
)

P2_CLASSES = f"""
WITH pairs AS ({P2_FOUND}), ends AS (SELECT finding_id_a AS id FROM pairs UNION ALL SELECT finding_id_b FROM pairs), degree AS (SELECT id, count(*) AS n FROM ends GROUP BY 1),
bags AS (SELECT finding_id AS id, list_sort(list_distinct(regexp_extract_all(lower(arg_max(coalesce(title, '') || ' ' || coalesce(description, ''), coalesce(ingested_at, TIMESTAMP '0001-01-01'))), '[a-z0-9]+'))) AS w FROM findings WHERE finding_id IS NOT NULL GROUP BY 1)
SELECT id AS finding_id, min(id) OVER (PARTITION BY w) AS class_id, count(*) OVER (PARTITION BY w) AS copies, coalesce(n, 0) AS n_links FROM bags LEFT JOIN degree USING (id) WHERE len(w) >= 20
"""

P2_GROUPS = f"""
WITH RECURSIVE pairs AS MATERIALIZED ({P2_FOUND}), both_ways AS (SELECT finding_id_a AS a, finding_id_b AS b FROM pairs UNION SELECT finding_id_b, finding_id_a FROM pairs),
known AS ({P2_CLASSES}), reach AS (SELECT finding_id AS id, finding_id AS root FROM known UNION SELECT b, root FROM reach JOIN both_ways ON a = id)
SELECT id AS finding_id, min(root) AS group_id FROM reach GROUP BY 1
"""

P3_REPORT = f"""
WITH pairs AS ({P3_FOUND}), known AS (SELECT report_id, arg_max(struct_pack(split := lower(split_name), source := lower(trim(source_name)), labels := array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(mitre_ids, []), lambda x: upper(trim(x))), lambda x: x IS NOT NULL AND x <> ''))), ','),
  words := list_sort(list_distinct(regexp_extract_all(lower(coalesce(technical_summary, '')), '[a-z0-9]+')))), coalesce(added_at, TIMESTAMP '0001-01-01')) AS k FROM reports WHERE report_id IS NOT NULL GROUP BY 1),
one AS (SELECT report_id, k.split AS split, k.source AS source, k.labels AS labels, k.words AS words FROM known), turned AS (SELECT CASE WHEN x.split = 'train' THEN b ELSE a END AS other_id, CASE WHEN x.split = 'train' THEN a ELSE b END AS train_id FROM (SELECT report_id_a AS a, report_id_b AS b FROM pairs) JOIN one x ON x.report_id = a),
per AS (SELECT other_id, count(*) AS pairs, max((o.words = t.words)::INTEGER) AS exact, count(*) FILTER (o.labels = t.labels) AS agreeing FROM turned JOIN one o ON o.report_id = other_id JOIN one t ON t.report_id = train_id GROUP BY 1)
SELECT split, source, count(*) AS records, count(pairs) AS overlapping, coalesce(sum(exact), 0)::BIGINT AS same_words, coalesce(sum(pairs), 0)::BIGINT AS pairs, coalesce(sum(agreeing), 0)::BIGINT AS pairs_same_labels, count(*) FILTER (pairs > agreeing) AS records_with_other_labels
FROM one LEFT JOIN per ON other_id = report_id WHERE split IS NOT NULL AND split <> 'train' GROUP BY 1, 2
"""

P5_FOUND = """
WITH best AS (
  SELECT pdf_path, batch_index, least(start_page, end_page) AS lo, greatest(start_page, end_page) AS hi FROM (
    SELECT *, row_number() OVER (PARTITION BY pdf_path, batch_index ORDER BY logged_at DESC NULLS LAST, entry_id DESC) AS k
    FROM progress WHERE status = 'ok' AND start_page IS NOT NULL AND end_page IS NOT NULL) WHERE k = 1),
pages AS (SELECT pdf_path, page_no, max(coalesce(length(page_text), 0)) AS n FROM pdf_pages GROUP BY 1, 2)
SELECT b.pdf_path, b.batch_index FROM best b JOIN pages p ON p.pdf_path = b.pdf_path AND p.page_no BETWEEN b.lo AND b.hi
GROUP BY 1, 2 HAVING sum(n) > 8000
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_classes": P2_CLASSES, "p2_groups": P2_GROUPS, "p3_found": P3_FOUND, "p3_report": P3_REPORT, "p5_found": P5_FOUND}
