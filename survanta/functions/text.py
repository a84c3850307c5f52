"""Text column functions: keys, slugs, tokens, whitespace, LaTeX clean-up, numbers in text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Words left out of keyword search.
STOPWORDS = (
    "а", "без", "более", "бы", "был", "была", "были", "было", "в", "во", "для", "до", "его", "ее", "если", "есть", "и", "из",
    "или", "к", "как", "ко", "на", "над", "не", "но", "о", "об", "от", "по", "при", "с", "со", "так", "то", "у", "что", "это",
    "этот", "эта", "эти", "the", "and", "or", "to", "of", "in", "for", "is", "are", "with", "as", "on", "by")

# LaTeX macros whose argument stays in the text.
HEADING_MACROS = ("section", "subsection", "subsubsection")
TEXT_MACROS = ("textbf", "textit", "texttt", "emph", "url", "href")

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

#: A name is the list of its words, in Spark and in Python alike.
NAME_WORD = "[a-z0-9]+"


def name_words(name: str) -> list[str]:
    return re.findall(NAME_WORD, name.lower())


def _name_words(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(NAME_WORD), F.lit(0))


def norm_key(s: Column) -> Column:
    """The words of a name without anything between."""
    return F.array_join(_name_words(s), "")


def slug(s: Column, fallback: str = "dataset") -> Column:
    """The words of a name joined by ``_``; ``fallback`` when there are none."""
    found = _name_words(s)
    return F.when(F.size(found) > 0, F.array_join(found, "_")).otherwise(F.lit(fallback))


def to_number(s: Column) -> Column:
    """Text to double or NULL, without Spark's type suffixes (``1d``); inf is kept, NaN is NULL."""
    text = s.cast("string")
    word = F.lower(F.trim(text))
    # Plain numbers leave at the first test; the words are looked at only for the rest.
    return (F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
            .when(word.rlike(r"^[+-]?inf(inity)?$"), F.when(word.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
            .when(word == "true", F.lit(1.0)).when(word == "false", F.lit(0.0)))


def tokenize(s: Column) -> Column:
    """Lower-case Latin, Cyrillic, digit and underscore runs of length 2 or more, without stop words."""
    words = F.regexp_extract_all(F.lower(s), F.lit("([A-Za-zА-Яа-яЁё0-9_]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))


def words(s: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores in any script."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def with_bigrams(words: Column) -> Column:
    """The words followed by each adjacent pair joined with a blank."""
    def both(ws):
        firsts = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0)))
        return F.concat(ws, F.transform(firsts, lambda w, i: F.concat(w, F.lit(" "), F.get(ws, i + 1))))

    # The one-element array binds the words, which are then split only once per row.
    return F.flatten(F.transform(F.array(words), both))


def compact_whitespace(s: Column) -> Column:
    """Unix line ends, no blanks at line ends, trimmed."""
    unix = F.regexp_replace(s, "\r\n", "\n")
    return F.regexp_replace(F.regexp_replace(unix, r"[ \t\f\r]+(?=\n|$)", ""), r"^\s+|\s+$", "")


def preview(s: Column, limit: int = 260) -> Column:
    """One-line preview with dots when cut."""
    line = F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^\s+|\s+$", "")
    cut = F.concat(F.regexp_replace(F.substring(line, 1, limit - 3), r"\s+$", ""), F.lit("..."))
    return F.when(F.length(line) > limit, cut).otherwise(line)


# What a scan of a LaTeX source meets next: a comment, a macro's name, one mark, or anything up to the next of these.
LATEX_NEXT = re.compile(r"%[^\n]*|\\[^\W\d_]+|[\\{}]|[^%\\{}]+")


def _argument(tex: str, at: int, opens: str, closes: str) -> int:
    """Where the argument that starts at ``at`` ends, its mark included; ``at`` if none starts there or another is inside."""
    if not tex.startswith(opens, at):
        return at
    stop = tex.find(closes, at)
    inner = tex.find(opens, at + 1)
    return at if stop < 0 or opens == "{" and (0 <= inner < stop or stop == at + 1) else stop + 1


def _latex_words(tex: str) -> str:
    """One walk over the source: plain text is kept, markup leaves a gap, arguments of heading and text macros are walked."""
    out, at = [], 0
    while at < len(tex):
        piece = LATEX_NEXT.match(tex, at)[0]
        at += len(piece)
        if piece[0] == "%":
            continue
        if piece in "{}":
            out.append(" ")
        elif piece[0] != "\\" or len(piece) == 1:
            out.append(piece)
        else:
            name, starred = piece[1:], tex.startswith("*", at)
            body = at + starred
            end = _argument(tex, body, "{", "}")
            heading = name in HEADING_MACROS
            if end > body and (heading or name in TEXT_MACROS and not starred):
                out.append(("# " if heading else "") + _latex_words(tex[body + 1:end - 1]))
                at = end
            else:
                out.append(" ")
                at = end if end > body and name in ("begin", "end") else _argument(tex, body, "[", "]")
    return "".join(out)


def clean_latex(s: Column) -> Column:
    """Readable text of a LaTeX source, a sentence a line.

    What a heading or text macro encloses is kept, a heading behind ``#``. All other markup (environment marks, macros
    with their options, braces) and blanks between words count as one gap. A source is walked in Arrow batches.
    """
    @pandas_udf("string")
    def walk(batch: pd.Series) -> pd.Series:
        return batch.map(_latex_words, na_action="ignore")

    return F.array_join(F.split(F.regexp_replace(walk(s), r"\s+", " "), r"(?<=\.) "), "\n")
