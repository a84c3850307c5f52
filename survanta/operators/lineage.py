"""Reliable checkpoints for plans that read one intermediate result many times."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def _checkpoint_dir(df: DataFrame) -> str:
    """The session's checkpoint folder, set from ``spark.checkpoint.dir`` when it has none yet."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            shared = tempfile.mkdtemp(prefix="survanta-", dir=os.environ.get("TMPDIR"))
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder named by ``spark.checkpoint.dir``.

    Used on aggregated intermediate results only. A lost executor costs a re-read,
    not a recomputation.
    """
    _checkpoint_dir(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As :func:`cut_lineage` for results with many rows: Parquet, which takes a fraction of a checkpoint's disk."""
    path = f"{_checkpoint_dir(df)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
