"""Numbers as text and parameter texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_DATA = "нет данных"
DASH = "—"


def _strip(text: Column) -> Column:
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def format_number(x: Column) -> Column:
    """One decimal from 100 on, three below (half to even), trailing zeros removed."""
    x = x.cast("double")
    text = F.when(F.abs(x) >= 100, F.format_string("%.1f", F.bround(x, 1))).otherwise(F.format_string("%.3f", F.bround(x, 3)))
    return F.when(_missing(x), F.lit(NO_DATA)).otherwise(_strip(text))


def format_short(x: Column) -> Column:
    """Whole numbers plainly, others with up to two decimals; a dash when missing."""
    x = x.cast("double")
    return F.when(_missing(x), F.lit(DASH)).when(
        x == F.floor(x), F.floor(x).cast("string")).otherwise(_strip(F.format_string("%.2f", F.bround(x, 2))))


def parse_params(text: Column) -> Column:
    """A parameter text (``{'a': 1, 'b': None}``) as a string map; empty when unreadable."""
    json = F.regexp_replace(text, r"'", '"')
    json = F.regexp_replace(json, r"\bNone\b", "null")
    json = F.regexp_replace(F.regexp_replace(json, r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))
