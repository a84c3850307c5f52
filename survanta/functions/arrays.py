"""Small array expressions shared by the curve, binning and prefix-sum code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _search(arr: Column, goes_right) -> Column:
    """Binary search: number of leading elements for which ``goes_right`` holds."""
    size = F.size(arr)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(size + F.lit(1))).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), size.alias("hi"))

    def halve(state, _):
        mid = F.shiftright(state["lo"] + state["hi"], 1)
        open_ = state["lo"] < state["hi"]
        right = open_ & goes_right(F.get(arr, mid))
        return F.struct(
            F.when(right, mid + F.lit(1)).otherwise(state["lo"]).alias("lo"),
            F.when(open_ & ~right, mid).otherwise(state["hi"]).alias("hi"),
        )

    found = F.aggregate(steps, start, halve, lambda s: s["lo"])
    return F.when(size == 0, F.lit(0)).otherwise(found)


def search_left(arr: Column, x: Column) -> Column:
    """How many elements of the sorted array are ``< x``."""
    return _search(arr, lambda e: e < x)


def search_right(arr: Column, x: Column) -> Column:
    """How many elements of the sorted array are ``<= x``."""
    return _search(arr, lambda e: e <= x)


def doubles(values) -> Column:
    """A short literal ``array<double>`` (grids, edges, split points)."""
    return F.array(*[F.lit(float(v)) for v in values]) if len(values) else F.array().cast("array<double>")


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
