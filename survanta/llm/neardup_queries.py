"""Query of the near-duplicate join, with its SQL."""

from __future__ import annotations

from . import neardup
from .registry import query, table

OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, greatest(len(ws) - 3, 2))]) AS sh
  FROM d WHERE len(ws) > 0),
class AS (SELECT min(doc_id) AS rep, list(doc_id) AS docs, any_value(sh) AS sh, len(any_value(sh)) AS n FROM (
  SELECT doc_id, list_sort(sh) AS sh FROM s) GROUP BY sh),
post AS (SELECT rep, n, unnest(sh) AS g FROM class),
pairs AS (SELECT a.rep AS a, b.rep AS b FROM post a JOIN post b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
sides AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT rep AS x, rep AS y FROM class UNION SELECT r.x, sides.b FROM reach r JOIN sides ON r.y = sides.a),
comp AS (SELECT x AS rep, min(y) AS component FROM reach GROUP BY x),
named AS (SELECT unnest(docs) AS doc_id, n, component FROM class JOIN comp USING (rep))
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, d.doc_id) AS component_id,
  d.doc_id = coalesce(component, d.doc_id) AS kept FROM d LEFT JOIN named ON d.doc_id = named.doc_id
"""


@query("op10_minhash_near_dedup", OP10_SQL)
def op10_minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))
