"""Method labels such as ``PiecewiseClassifWrapSA(Model, times=8)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the label form of interval models.
PIECEWISE = r"^(Piecewise(?:CensorAware)?ClassifWrapSA)\(([^,]+),\s*times=(\d+)\)$"
BASE = r"^ClassifWrapSA\((.+)\)$"


def parse(method: Column) -> Column:
    """``struct(family, base_model, times)``; NULL fields when the label is another method."""
    text = F.trim(method)
    part = lambda i: F.nullif(F.regexp_extract(text, PIECEWISE, i), F.lit(""))
    return F.struct(part(1).alias("family"), part(2).alias("base_model"), part(3).cast("int").alias("times"))


def base_of(method: Column) -> Column:
    """Model name inside ``ClassifWrapSA(...)``, else NULL."""
    return F.nullif(F.regexp_extract(method, BASE, 1), F.lit(""))


def variant(method: Column) -> Column:
    """Short display label of an interval model; other labels stay."""
    p = parse(method)
    short = F.when(p["family"] == "PiecewiseCensorAwareClassifWrapSA", "Censor-aware").otherwise("Piecewise")
    return F.when(p["family"].isNull(), method).otherwise(
        F.concat(short, F.lit(", times="), p["times"].cast("string")))


def build(family: Column, base_model: Column, times: Column) -> Column:
    return F.concat(family, F.lit("("), base_model, F.lit(", times="), times.cast("string"), F.lit(")"))
