"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document and leaves one failure bit next to the measurements it used. Policies are
versioned masks over these bits, so a new policy, a comparison of policies or an ablation needs no second look at the
texts. Measuring runs in one pass without a shuffle; the reports aggregate the distinct bit patterns (at most two to
the number of rules) and work on those alone.

Defined cases: null and empty texts have no words and fail ``few_words``; a row of the input is a row of the ledger,
repeated rows included; an empty table gives an empty ledger; only the named text column is read and the ledger columns
are added beside whatever the table has, under names the caller can prefix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .words import WordCodes, windows

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Bit position of a rule and when it fails. The order is part of the stored format: append only.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails more than ``allowed`` of the named rules, or any of ``fatal``."""

    name: str
    version: int
    rules: tuple[str, ...]
    fatal: tuple[str, ...] = ()
    allowed: int = 0

    def rejects(self, bits: Column) -> Column:
        out = F.bit_count(bits.bitwiseAND(F.lit(mask(self.rules)))) > self.allowed
        return out | (bits.bitwiseAND(F.lit(mask(self.fatal))) != 0) if self.fatal else out


#: Version 1: only the two base rules. Version 2: any of all rules.
BASE = Policy("web", 1, ("few_words", "repeated_windows"))
PRODUCTION = Policy("web", 2, tuple(RULES))


def mask(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def _repeat_words(codes: np.ndarray) -> int:
    h = windows(codes, WINDOW)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(twice)
    edges[at] += 1
    edges[at + WINDOW] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: str | None, codes: WordCodes) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    # Code points of words: all bytes that do not continue a character, less the six space characters.
    points = len(text or "")
    spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (len(words), points - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines),
            len(lines) - len(set(lines)), _repeat_words(codes.of(words)))


def measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    codes = WordCodes()
    for part in texts:
        yield pd.DataFrame([measure(t, codes) for t in part], columns=list(MEASURES), dtype="int64")


def ledger(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with the measurements and ``fail_bits`` appended, each name after ``prefix``.

    A column of ``df`` with one of these names is replaced, so give a prefix where names clash.
    """
    m = f"{prefix}measured"
    kind = "struct<" + ",".join(f"{x}:bigint" for x in MEASURES) + ">"
    out = df.withColumn(m, F.pandas_udf(measures, kind).asNondeterministic()(F.col(f"`{text}`")))
    out = out.withColumns({prefix + x: F.col(f"`{m}`.{x}") for x in MEASURES}).drop(m)
    names = {x: f"`{prefix}{x}`" for x in MEASURES}
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        said = " ".join(names.get(t, t) for t in rule.split())
        bits = bits + F.when(F.expr(said), F.lit(1 << i)).otherwise(0).cast("long")
    return out.withColumn(prefix + "fail_bits", bits)


def patterns(ledger_rows: DataFrame, bits: str = "fail_bits") -> DataFrame:
    """Documents per distinct bit pattern: all that policies and ablations need."""
    return ledger_rows.groupBy(F.col(bits).alias("bits")).agg(F.count("*").alias("n"))


def policy_report(ledger_rows: DataFrame, policies: list[Policy], bits: str = "fail_bits") -> DataFrame:
    """Per policy version: documents, rejected ones, and the rules that failed anywhere or everywhere among them."""
    spark = ledger_rows.sparkSession
    seen = patterns(ledger_rows, bits)
    out = None
    for p in policies:
        bad = p.rejects(F.col("bits"))
        row = seen.agg(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.sum("n").alias("n_docs"),
                       F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("n_rejected"),
                       F.bit_or(F.when(bad, F.col("bits"))).alias("any_bits"),
                       F.bit_and(F.when(bad, F.col("bits"))).alias("all_bits"))
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame(
        [], "policy string, version int, n_docs long, n_rejected long, any_bits long, all_bits long")


def ablation(ledger_rows: DataFrame, policy: Policy, bits: str = "fail_bits") -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that would be kept were this rule dropped."""
    seen = patterns(ledger_rows, bits)
    aggs = []
    for r in policy.rules:
        one = F.col("bits").bitwiseAND(F.lit(mask([r]))) != 0
        without = Policy(policy.name, policy.version, tuple(x for x in policy.rules if x != r),
                         tuple(x for x in policy.fatal if x != r), policy.allowed)
        freed = policy.rejects(F.col("bits")) & ~without.rejects(F.col("bits"))
        aggs.append(F.struct(F.lit(r).alias("rule"), F.coalesce(F.sum(F.when(one, F.col("n"))), F.lit(0)).alias("n_failed"),
                             F.coalesce(F.sum(F.when(freed, F.col("n"))), F.lit(0)).alias("n_only_here")))
    return seen.agg(F.array(*aggs).alias("r")).select(F.inline("r"))


def judged(df: DataFrame, text: str = "text", policy: Policy = PRODUCTION, prefix: str = "") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``, false where a base rule fails and else the policy's verdict."""
    out = ledger(df, text, prefix)
    bits = F.col(f"`{prefix}fail_bits`")
    base = BASE.rejects(bits)
    return out.withColumns({prefix + "base_failed": base, prefix + "kept": ~base & ~policy.rejects(bits)})


def keep_good(df: DataFrame, text: str = "text", policy: Policy = PRODUCTION) -> DataFrame:
    """The rows that ``policy`` keeps, with the columns of ``df`` alone, whatever they are called."""
    packed = df.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("text"))
    return judged(packed, "text", policy).filter("kept").select("row.*")
