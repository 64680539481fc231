"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Lower-cases A-Z only.
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {}

ORACLE["op1_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(_LOWER.format('text'))} AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), i -> array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
), k AS (
  SELECT doc_id, len(sh) AS n, CASE WHEN len(sh) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(sh)) END AS class_id, sh FROM s
), u AS (
  SELECT doc_id, n, unnest(sh) AS g FROM k WHERE doc_id = class_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
), r AS (
  SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a
), c AS (
  SELECT x, min(y) AS y FROM r GROUP BY x
)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, coalesce(c.y, k.class_id) AS component_id, k.class_id AS class_id
FROM k LEFT JOIN c ON k.class_id = c.x
"""
