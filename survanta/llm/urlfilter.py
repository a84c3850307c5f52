"""URL rules by a cascade of Bloom filters.

Level 1 holds the listed keys. Level 2 holds those keys of the corpus's universe that pass level 1 without being
listed, level 3 the listed keys that pass level 2, and so on until a level lets nothing wrong through. A key of the
universe is listed exactly if the first level that it fails has an even number, so lookups need no join and no list.
Keys are two 64-bit hashes taken in Spark. Building is distributed: each level's bits are set per partition and united
by bitwise or. Keys are dealt over shards so that the first level of a shard stays under ``SHARD_KEYS`` keys; what is
broadcast at once is therefore bounded.

Defined cases: a null key is never listed; an empty list lists nothing; an empty universe makes a cascade of one level;
repeated keys count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .words import ODD, mixed

SHARD_KEYS = 4_000_000
_CHUNK = 1 << 16  # bytes of a filter that travel in one row


class Bloom:
    """``level`` seeds the hashes, so that what two keys share on one level they do not share on the next."""

    def __init__(self, n: int, rate: float, level: int = 1):
        self.seed = np.uint64(level) * ODD
        bits = max(64, int(math.ceil(-max(n, 1) * math.log(rate) / math.log(2) ** 2)))
        self.size = -(-bits // 8) * 8
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = np.zeros(self.size // 8, np.uint8)

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = mixed(a + self.seed), mixed(b ^ self.seed)
        steps = np.arange(1, self.hashes + 1, dtype=np.uint64)[:, None]
        return (a[None, :] + steps * (b | np.uint64(1))[None, :]) % np.uint64(self.size)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        at = self.places(a, b).ravel()
        np.bitwise_or.at(self.bits, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.places(a, b)
        return ((self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def listed(levels: list[Bloom], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the first level it fails is even, or it passes an odd number of levels in all."""
    inside = np.ones(len(a), bool)
    failed_at = np.full(len(a), len(levels) + 1)
    for i, level in enumerate(levels, 1):
        at = np.flatnonzero(inside)
        if not len(at):
            break
        passed = level.has(a[at], b[at])
        failed_at[at[~passed]] = i
        inside[at[~passed]] = False
    return failed_at % 2 == 0


def hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(1)).alias("b"))


def unsigned(s) -> np.ndarray:
    return np.asarray(s, dtype=np.int64).view(np.uint64)


def filled(keys: DataFrame, n: int, rate: float, level: int) -> Bloom:
    """One level over the keys (columns a, b)."""
    size = len(Bloom(n, rate, level).bits)

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        for p in parts:
            if len(p):
                own = own or Bloom(n, rate, level)
                own.add(unsigned(p["a"]), unsigned(p["b"]))
        if own is not None:
            at = range(0, size, _CHUNK)
            yield pd.DataFrame({"at": list(at), "bits": [own.bits[i:i + _CHUNK].tobytes() for i in at]})

    def unite(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["bits"]])
        return pd.DataFrame({"at": [key[0]], "bits": [bits.tobytes()]})

    out = Bloom(n, rate, level)
    rows = keys.mapInPandas(fill, "at long, bits binary").groupBy("at").applyInPandas(unite, "at long, bits binary")
    for r in rows.toLocalIterator():
        out.bits[r["at"]:r["at"] + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def build(keys: DataFrame, universe: DataFrame, rate: float = 0.01, shard_keys: int = SHARD_KEYS) -> list[list[Bloom]]:
    """A cascade per shard, from one column of listed keys and one of the corpus's distinct keys."""
    def prepared(df):
        return (df.select(hashed(F.col(f"`{df.columns[0]}`")).alias("h")).filter(F.col(f"`{df.columns[0]}`").isNotNull())
                .select("h.a", "h.b").distinct())
    yes_all = prepared(keys).cache()
    no_all = prepared(universe).join(yes_all, ["a", "b"], "left_anti").cache()
    shards = max(1, math.ceil(yes_all.count() / shard_keys))
    out = []
    for s in range(shards):
        yes, no = (df.filter(F.pmod("b", F.lit(shards)) == s) for df in (yes_all, no_all))
        levels, inside, other, n = [], yes, no, yes.count()
        while n:
            levels.append(filled(inside, n, rate if not levels else 0.5, len(levels) + 1))
            sent = other.sparkSession.sparkContext.broadcast(levels[-1])

            def passing(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
                for p in parts:
                    yield p[sent.value.has(unsigned(p["a"]), unsigned(p["b"]))] if len(p) else p

            wrong = other.mapInPandas(passing, "a long, b long").cache()
            inside, other, n = wrong, inside, wrong.count()
        out.append(levels)
    yes_all.unpersist()
    no_all.unpersist()
    return out


def first_listed(keys: Column, spark, *cascades: list[list[Bloom]]) -> Column:
    """Struct (place, which): the first key of the array that a cascade lists, and the number of that cascade; -1 if none.

    ``keys`` is an array of strings, its members in order of preference.
    """
    sent = spark.sparkContext.broadcast(cascades)

    def look(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        n = a.map(len).to_numpy()
        flat_a, flat_b = (unsigned(np.concatenate([np.asarray(x, np.int64) for x in s]) if n.sum() else np.zeros(0, np.int64)) for s in (a, b))
        which = np.full(len(flat_a), -1)
        for c, shards in enumerate(sent.value):
            shard = np.mod(flat_b.view(np.int64), len(shards))
            for s, levels in enumerate(shards):
                at = np.flatnonzero((shard == s) & (which < 0))
                if levels and len(at):
                    which[at[listed(levels, flat_a[at], flat_b[at])]] = c
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n) if len(n) else row
        hit = np.flatnonzero(which >= 0)
        rows, first = np.unique(row[hit], return_index=True)
        out = pd.DataFrame({"place": np.full(len(n), -1), "which": np.full(len(n), -1)})
        out.loc[rows, "place"] = place[hit][first]
        out.loc[rows, "which"] = which[hit][first]
        return out.astype("int32")

    both = F.coalesce(keys, F.array().cast("array<string>"))
    return F.pandas_udf(look, "struct<place:int,which:int>")(
        F.transform(both, lambda k: F.xxhash64(k)), F.transform(both, lambda k: F.xxhash64(k, F.lit(1))))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    found = F.coalesce(F.locate("://", url), F.lit(0)) > 0
    rest = F.when(found, F.regexp_replace(url, r"^(?s).*?://", "")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return host, path


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every rule that could fit: each suffix of whole labels of the host with each prefix of the path that has one of
    the given lengths, the longest first."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    heads = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda x: x.isNotNull())
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(heads, lambda p: F.concat(h, p))))
    return F.transform(F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))), lambda s: s["k"])


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with the columns host, path, rule and verdict, which replace any of these names.

    ``rules`` has rule (host and path in one string, as ``net/``) and action (allow or block). Where both actions list
    a rule, block holds. A url that no rule fits gets ``default``: the cascades prove that nothing listed fits it.
    """
    spark = pages.sparkSession
    lengths = [r["n"] for r in rules.filter("rule IS NOT NULL").select(
        F.length(F.regexp_extract("rule", r"/.*$", 0)).alias("n")).distinct().orderBy("n").collect()]
    host, path = parts(F.col(f"`{url}`"))
    seen = pages.withColumns({"host": host, "path": path})
    keyed = seen.withColumn("_keys", candidates(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>"))
    universe = keyed.select(F.explode("_keys").alias("key")).distinct()
    block = build(rules.filter("action = 'block'").select("rule"), universe)
    allow = build(rules.filter("action = 'allow'").select("rule"), universe)
    hit = keyed.withColumn("_hit", first_listed(F.col("_keys"), spark, block, allow))
    found = F.col("_hit.place") >= 0
    return hit.withColumns({
        "rule": F.when(found, F.element_at("_keys", F.col("_hit.place") + 1)),
        "verdict": F.when(~found, F.lit(default)).when(F.col("_hit.which") == 0, "block").otherwise("allow")}).drop("_keys", "_hit")
