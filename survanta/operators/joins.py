"""Join helper that stays correct with NULL keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; keeps the left key columns.

    No side is hinted: Spark broadcasts a side only after measuring it, and splits
    the partitions of a hot key otherwise (adaptive skew join).
    """
    keys = list(keys)
    if not keys:
        # One side is a one-row aggregate over the whole input.
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])
