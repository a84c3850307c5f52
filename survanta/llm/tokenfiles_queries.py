"""Query of the token files. SQL has no tokenizer; tests hold it against the library and a plain layout."""

from __future__ import annotations

import public_tokenizers

from . import tokenfiles
from .bpe_queries import TOKENIZER
from .registry import query, table
from .shared import new_path


@query("op9_token_files")
def op9_token_files(spark, sf_dir):
    folder = new_path(spark, "token-files")
    manifest = tokenfiles.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return tokenfiles.read(manifest, folder, crc_width=4)
