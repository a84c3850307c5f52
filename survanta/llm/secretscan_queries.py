"""Query of the secret scan, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import secretscan
from .registry import query, table


def count(kind):
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


@query("op7_secret_scans")
def op7_secret_scans(spark, sf_dir):
    got = secretscan.secrets(table(spark, sf_dir, "documents"))
    return got.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                      F.sha2(secretscan.named("base"), 256).alias("base_sha256"), secretscan.named("spans").alias("spans"))
