"""Query of periodic runs.

In one document of ten the words from some place on repeat a stretch, as the task sets it, so that long runs exist; all
others are judged as they are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import runs
from .registry import query, table

BREAKS = r"[\x20\x09-\x0D]+"


def with_repeats(docs):
    """``documents`` with the words of every tenth id (by CRC-32) made periodic from a place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), BREAKS), lambda w: w != "")
    part = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, words).alias("w"))
    part = part.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    part = part.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    text = F.array_join(F.concat(F.slice("w", 1, F.col("a")), F.transform(
        F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))), " ")
    return part.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), text).otherwise(F.col("text")).alias("text"))


#: Each period's equal pairs of words, their unbroken stretches, and of stretches with equal ends the smallest period.
SQL = r"""
WITH crc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda c: [256 + ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x - 256) WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END), 4294967295) AS h
  FROM documents),
place AS (SELECT doc_id, w, h, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM crc),
step AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM place),
text_words AS (SELECT doc_id, n, unnest(range(n)) AS i,
    unnest(CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda k: w[CASE WHEN k >= a THEN a + (k - a) % p ELSE k END + 1]) END) AS w FROM step),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM text_words x JOIN text_words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
numbered AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS s, min(i) + count(*) + q AS e FROM numbered GROUP BY doc_id, q, g HAVING count(*) >= q AND count(*) + q >= 12),
runs AS (SELECT doc_id, s, e, min(q) AS q FROM stretches GROUP BY doc_id, s, e),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS txt FROM runs GROUP BY doc_id),
best AS (SELECT doc_id, s, e - s AS length, q FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, s, q) = 1),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM runs),
kept AS (SELECT t.doc_id, string_agg(t.w, ' ' ORDER BY t.i) AS txt FROM text_words t ANTI JOIN dropped d ON t.doc_id = d.doc_id AND t.i = d.i GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.s AS start, b.length, b.q AS period, 1000 * b.length // b.q AS exponent_milli,
  sha256(coalesce(l.txt, '')) AS runs_sha256, sha256(coalesce(k.txt, '')) AS collapsed_sha256
FROM documents d LEFT JOIN lines l USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


@query("op11_periodic_runs", SQL)
def op11_periodic_runs(spark, sf_dir):
    found = runs.runs(with_repeats(table(spark, sf_dir, "documents")))
    best = F.reduce("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"),
                    lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
