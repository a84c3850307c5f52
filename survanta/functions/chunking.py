"""Cut texts into titled sections and sections into chunks, inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact_whitespace

HEADING = r"^\s{0,3}#{1,6}\s+(.+?)\s*$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sections(text: Column, default_title: Column) -> Column:
    """``array<struct<title, text>>``: a section starts at each heading line.

    Text before the first heading gets ``default_title``; a text without any content
    has no sections.
    """
    def starts(ls):
        return F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: (i == 0) | F.get(ls, i).rlike(HEADING))

    def section(ls, begin, end):
        head = F.get(ls, begin)
        title = F.when(head.rlike(HEADING), F.regexp_extract(head, HEADING, 1)).otherwise(default_title)
        body = F.array_join(F.slice(ls, begin + 1, end - begin), "\n")
        return F.struct(title.alias("title"), _strip(body).alias("text"))

    # One-element arrays bind the lines and the starts, so that each is computed once per row.
    lines = F.array(F.split(compact_whitespace(text), "\n"))
    bound = F.transform(lines, lambda ls: F.struct(ls.alias("l"), starts(ls).alias("s")))
    made = F.flatten(F.transform(bound, lambda b: F.transform(
        b["s"], lambda at, i: section(b["l"], at, F.coalesce(F.get(b["s"], i + 1), F.size(b["l"]))))))
    return F.when(~text.rlike(r"\S"), F.array().cast("array<struct<title:string,text:string>>")).otherwise(made)


def pack(text: Column, max_chars: int = 1500) -> Column:
    """``array<string>``: paragraphs packed greedily up to ``max_chars``; longer ones are cut hard."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), _strip), lambda p: p != "")
    size = F.lit(max_chars)

    def hard_cut(p):
        n = F.ceil(F.length(p) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: _strip(F.substring(p, i * size + 1, size)))

    def step(state, p):
        done, open_ = state["done"], state["open"]
        flushed = F.when(open_ == "", done).otherwise(F.concat(done, F.array(open_)))
        joined = F.when(open_ == "", p).otherwise(F.concat(open_, F.lit("\n\n"), p))
        long_, full = F.length(p) > size, F.length(joined) > size
        return F.struct(
            F.when(long_, F.concat(flushed, hard_cut(p))).when(full, flushed).otherwise(done).alias("done"),
            F.when(long_, F.lit("")).when(full, p).otherwise(joined).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.aggregate(paragraphs, start, step, lambda s: F.when(
        s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
