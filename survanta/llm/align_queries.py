"""Query of token alignment. SQL has no tokenizers; tests hold it against a plain alignment with the two libraries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import align
from .registry import query, table

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    done = align.align(table(spark, sf_dir, "documents"), public_tokenizers.path(A), public_tokenizers.path(B))
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                       F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))
