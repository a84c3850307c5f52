"""Query of byte-level BPE. SQL has no tokenizer; tests hold it against the tiktoken library on whole texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bytebpe
from .registry import query, table

RANKS = "byte_bpe_multi_50k.tiktoken"


@query("op13_byte_bpe")
def op13_byte_bpe(spark, sf_dir):
    done = bytebpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
