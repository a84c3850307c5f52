"""Query of BPE encoding and decoding. SQL has no tokenizer; tests hold it against the library on whole texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe
from .registry import query, table

TOKENIZER = "word_bpe_49k.json"


def digests(encoded):
    """The digest columns from the operator's ids and texts."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_bpe_encoding")
def op8_bpe_encoding(spark, sf_dir):
    return digests(bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))
