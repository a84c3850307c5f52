"""Query of the toxicity model. SQL cannot express the fit; tests hold it against brute force and held-out labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import toxicity
from .registry import query, table

HELD = 1


def fold(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string")) % 3


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(fold() != HELD)
    model = toxicity.train(docs.filter(fold() != HELD), labels)
    out = docs.select("doc_id", (fold() == HELD).alias("held_out"), toxicity.scored(F.col("text"), model).alias("s"))
    score = F.col("s.score")
    return out.select("doc_id", "held_out", score.alias("score"), F.when(score >= 0.7, 1).otherwise(0).alias("predicted"),
                      F.col("s.offending").alias("offending"))
