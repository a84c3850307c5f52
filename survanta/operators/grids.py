"""Time grids and interval edges, as one row per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.curve import linspace
from .joins import join_keys
from .prefix import quantiles


def _finite(df: DataFrame, time: str) -> DataFrame:
    t = F.col(time)
    return df.where(t.isNotNull() & ~F.isnan(t.cast("double")) & (F.abs(t) < F.lit(float("inf"))))


def bounds(df: DataFrame, time: str, start_at_zero: bool = True, by=()) -> DataFrame:
    """``start`` and ``end`` of the time axis; an empty range is widened by one."""
    left = F.lit(0.0) if start_at_zero else F.min(F.col(time).cast("double"))
    span = _finite(df, time).groupBy(*by).agg(left.alias("start"), F.max(F.col(time).cast("double")).alias("_end"))
    return span.select(*by, "start", F.when(F.col("_end") <= F.col("start"), F.col("start") + 1.0)
                       .otherwise(F.col("_end")).alias("end"))


def grid(df: DataFrame, time: str, n: int = 128, start_at_zero: bool = True, by=()) -> DataFrame:
    """Evenly spaced time grid of ``n`` points per group, column ``grid``."""
    b = bounds(df, time, start_at_zero, by)
    return b.select(*by, linspace(F.col("start"), F.col("end"), int(n)).alias("grid"))


def edges(df: DataFrame, time: str, times: int = 8, start_at_zero: bool = True, by=(),
          uniform: bool = False) -> DataFrame:
    """Interval edges per group, column ``edges``: exact quantiles (or even steps),
    with the ends forced to the axis bounds and repeated edges removed."""
    n = max(int(times), 2)
    b = bounds(df, time, start_at_zero, by)
    if uniform:
        return b.select(*by, linspace(F.col("start"), F.col("end"), n).alias("edges"))
    if n == 2:
        return b.select(*by, F.array("start", "end").alias("edges"))
    q = quantiles(_finite(df, time), time, [i / (n - 1) for i in range(1, n - 1)], by)
    inner = q.groupBy(*by).agg(F.collect_list("value").alias("_mid"))  # n - 2 values
    both = F.array_sort(F.array_distinct(F.concat(F.array("start"), "_mid", F.array("end"))))
    kept = F.filter(both, lambda e: (e >= F.col("start")) & (e <= F.col("end")))
    return join_keys(b, inner, by).select(*by, kept.alias("edges"))


def to_list(one_row: DataFrame, column: str) -> list[float]:
    """A short grid or edge vector as a Python list (one row, fixed length)."""
    row = one_row.select(column).first()
    return [float(x) for x in row[0]] if row and row[0] else []
