"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A signature holds ``CHUNKS * CHUNK`` minima of the shingle set, ``b`` = 8 bits of each; its distance to another is the
number of places that differ. Signatures are split into ``CHUNKS`` chunks. If two are at most ``2 * CHUNKS - 1`` apart,
some chunk has at most one error (pigeonhole), so the keys of a chunk that leave out one place each bring together every
such pair. Beyond that distance the keys still meet with high odds: at a similarity of 0.75 a pair is missed with a
chance below 1e-4, falling fast above. Candidates whose distance is out of reach of 0.75 are dropped (``FAR``, and
``FAR_LONG`` on a second signature of ``LONG`` places of 4 bits, each four and a half standard deviations), the others confirmed on
the full sets.

No group is expanded into all its pairs. Documents with equal sets are one class with its smallest id as
representative. In each bucket the members are compared with one pivot, the smallest representative; confirmed links
give components; only buckets that still hold several components go on. There the signatures of members of different
components are compared in blocks of bounded size, and only pairs within reach come out, once however many buckets
they share. So thousands of near copies cost one comparison each, and no link between different components is lost.

Shingle sets are computed for members of shared buckets only, found in the scan through a Bloom filter of bounded size
whose false positives do no harm.

Defined cases: null or empty texts have an empty set, are in no class and keep themselves; texts of fewer words than a
shingle are one shingle; rows with a null id are linked with nothing, have a null component and are kept; repeated rows
share a class; an empty table gives an empty result; only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import stored
from .urlfilter import filled, unsigned
from .words import MIX, ODD, WordCodes, mixed, shingle_set, words_of

SHINGLE = 5
SHARE = 75
CHUNKS, CHUNK = 16, 7
FAR = 48
LONG, FAR_LONG = 512, 163
BLOCK = 1024
BLOOM_KEYS = 4_000_000
_ALL = mixed((np.arange(1, CHUNKS * CHUNK + LONG + 1, dtype=np.uint64) * ODD)) | np.uint64(1)
_SHORT, _LONG = _ALL[:CHUNKS * CHUNK], _ALL[CHUNKS * CHUNK:]


def signature(s: np.ndarray, multipliers: np.ndarray = _SHORT) -> np.ndarray:
    """8 bits of each minimum, as bytes."""
    low = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(low, (s[i:i + 4096, None] * multipliers[None, :]).min(axis=0), out=low)
    return (mixed(low) >> np.uint64(56)).astype(np.uint8)


def long_signature(s: np.ndarray) -> np.ndarray:
    """4 bits of each of ``LONG`` further minima, two to a byte."""
    low = signature(s, _LONG) & 15
    return (low[::2] << 4) | low[1::2]


def long_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of long signatures that differ, along the last axis."""
    d = x ^ y
    return ((d & 15) != 0).sum(axis=-1) + ((d >> 4) != 0).sum(axis=-1)


def keys_of(sigs: np.ndarray) -> np.ndarray:
    """Keys (row, chunk * place left out) of signatures as a matrix of bytes."""
    parts = sigs.reshape(len(sigs), CHUNKS, CHUNK).astype(np.uint64)
    out = np.empty((len(sigs), CHUNKS, CHUNK), np.uint64)
    base = (np.arange(CHUNKS, dtype=np.uint64)[None, :] + np.uint64(1)) * ODD
    for left_out in range(CHUNK):
        h = base + np.array(left_out, np.uint64)[None] * MIX
        for j in range(CHUNK):
            if j != left_out:
                h = mixed(h * ODD + parts[:, :, j])
        out[:, :, left_out] = h
    return out.reshape(len(sigs), CHUNKS * CHUNK)


def _sets(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("t"))


def signatures(docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """doc_id, n (set size), the 128-bit name of the set, and its signature."""
    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = WordCodes()
        for part in parts:
            rows = []
            for t in part["t"]:
                s = shingle_set(codes.of(words_of(t)), k)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, signature(s).tobytes() if len(s) else None))
            yield pd.DataFrame({"doc_id": part["doc_id"], "n": [r[0] for r in rows], "name": [r[1] for r in rows], "sig": [r[2] for r in rows]})

    rows = _sets(docs, id_col, text)
    return rows.mapInPandas(sign, f"doc_id {dict(rows.dtypes)['doc_id']}, n long, name binary, sig binary")


def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b)) if len(a) else (np.zeros((0, 1), np.uint8),) * 2
    return pd.Series(long_distance(x, y), dtype="int32")


def _linked(share: int):
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            inside = int((both[1:] == both[:-1]).sum())
            out.append(100 * inside >= share * (len(x) + len(y) - inside))
        return pd.Series(out, dtype=bool)
    return linked


def needed_sets(docs: DataFrame, ids: DataFrame, n: int, id_col: str, text: str, k: int) -> DataFrame:
    """(rep, s, long) of the documents whose ids are in ``ids``: the sorted set as bytes and a longer signature. Reads the
    texts once."""
    bloom = filled(ids.select(F.xxhash64("rep").alias("a"), F.xxhash64("rep", F.lit(1)).alias("b")), min(max(n, 1), BLOOM_KEYS), 0.01, 1)
    sent = docs.sparkSession.sparkContext.broadcast(bloom)
    rows = _sets(docs, id_col, text).filter("doc_id IS NOT NULL").withColumns({"a": F.xxhash64("doc_id"), "b": F.xxhash64("doc_id", F.lit(1))})

    def sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = WordCodes()
        for part in parts:
            part = part[sent.value.has(unsigned(part["a"]), unsigned(part["b"]))] if len(part) else part
            got = [(rep, s.tobytes(), long_signature(s).tobytes()) for rep, t in zip(part["doc_id"], part["t"])
                   if len(s := shingle_set(codes.of(words_of(t)), k))]
            yield pd.DataFrame(got, columns=["rep", "s", "long"])

    return rows.mapInPandas(sets, f"rep {dict(rows.dtypes)['doc_id']}, s binary, long binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of ``docs``."""
    signed = stored(signatures(docs, id_col, text, k), "signatures")
    classes = stored(signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("name").agg(
        F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    id_kind = dict(classes.dtypes)["rep"]

    def explode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), 2000):
                p = part.iloc[i:i + 2000]
                keys = keys_of(np.frombuffer(b"".join(p["sig"]), np.uint8).reshape(len(p), -1))
                yield pd.DataFrame({"key": keys.ravel().view(np.int64), "at": np.tile(np.arange(keys.shape[1], dtype=np.int16), len(p)),
                                    "rep": np.repeat(p["rep"].to_numpy(), keys.shape[1])})

    keys = classes.select("rep", "sig").mapInPandas(explode, f"key long, at short, rep {id_kind}")
    shared = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("c")).filter("c > 1")
    members = stored(keys.join(shared, "key"), "buckets")
    ids = stored(members.select("rep").distinct(), "bucket-members")
    n = ids.count()
    if not n:
        links = None
    else:
        sigs = stored(classes.select("rep", "sig").join(ids, "rep"), "member-signatures")
        sets = stored(needed_sets(docs, ids, n, id_col, text, k).join(ids, "rep").dropDuplicates(["rep", "s"]), "member-sets")

        def confirmed(pairs: DataFrame) -> DataFrame:
            """Pairs (a, b) that are linked, by the long signature and then by set."""
            far = F.pandas_udf(_distance, "int")
            near = (pairs.join(sets.select(F.col("rep").alias("a"), F.col("long").alias("long_a")), "a")
                    .join(sets.select(F.col("rep").alias("b"), F.col("long").alias("long_b")), "b")
                    .filter(far("long_a", "long_b") <= FAR_LONG).select("a", "b").distinct())
            return by_set(near)

        def by_set(near: DataFrame) -> DataFrame:
            full = (near.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("s_a")), "a")
                    .join(sets.select(F.col("rep").alias("b"), F.col("s").alias("s_b")), "b"))
            return full.filter(F.pandas_udf(_linked(share), "boolean")("s_a", "s_b")).select("a", "b")

        first = members.filter("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
        links = stored(confirmed(first), "star-links")
        both = sigs.join(sets.select("rep", "long"), "rep")
        links = links.unionByName(by_set(_between(members, components(links), both)))
    found = components(stored(links, "links")) if links is not None else None
    named = classes.select("name", F.col("rep"))
    if found is not None:
        named = named.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("name", F.coalesce("component", "rep").alias("component"))
    else:
        named = named.withColumnRenamed("rep", "component")
    out = signed.select("doc_id", "n", "name").join(named, "name", "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn(
        "kept", F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _between(members: DataFrame, found: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of different components in one bucket that no pivot has seen, within ``FAR`` and ``FAR_LONG`` of each other.

    A bucket is cut into blocks by the hash of the member, and each two blocks are one unit of work that compares their
    signatures as matrices. A pair comes out in the first of the buckets that it shares, so once.
    """
    rows = (members.filter("c > 2").join(found.withColumnRenamed("node", "rep"), "rep", "left")
            .withColumn("component", F.coalesce("component", "rep")))
    several = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    open_rows = rows.filter("rep <> pivot").join(several, "key").join(sigs, "rep")
    n = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), n).cast("int")
    dealt = open_rows.select("key", "at", "rep", "component", "sig", "long", own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other")).select(
        "key", "at", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component", "sig", "long")
    work = dealt.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in _runs(parts, ["key", "i", "j"]):
            at, i, j = int(unit["at"].iloc[0]), unit["i"].iloc[0], unit["j"].iloc[0]
            own, rep, comp = unit["own"].to_numpy(), unit["rep"].to_numpy(), unit["component"].to_numpy()
            sig = np.frombuffer(b"".join(unit["sig"]), np.uint8).reshape(len(unit), -1)
            long = np.frombuffer(b"".join(unit["long"]), np.uint8).reshape(len(unit), -1)
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            out = []
            for x in left:
                ys = right if i != j else right[right > x]
                ys = ys[comp[ys] != comp[x]]
                ys = ys[(sig[ys] != sig[x]).sum(axis=1) <= FAR] if len(ys) else ys
                ys = ys[long_distance(long[ys], long[x]) <= FAR_LONG] if len(ys) else ys
                if len(ys):
                    ys = ys[_first_key(sig[x], sig[ys]) == at]
                    out += [(min(rep[x], r), max(rep[x], r)) for r in rep[ys]]
            yield pd.DataFrame(out, columns=["a", "b"])

    kind = dict(members.dtypes)["rep"]
    return work.mapInPandas(compare, f"a {kind}, b {kind}").distinct()


def _first_key(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Number of the first key that each of ``others`` shares with ``one``; they share one."""
    wrong = (others != one).reshape(len(others), CHUNKS, CHUNK)
    chunk = (wrong.sum(axis=2) <= 1).argmax(axis=1)
    return chunk * CHUNK + wrong[np.arange(len(others)), chunk].argmax(axis=1)


def _runs(parts: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows that agree in ``by``, over the borders of batches."""
    rest: list[pd.DataFrame] = []
    for part in parts:
        if not len(part):
            continue
        keys = part[by].to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(part)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            run = part.iloc[a:b]
            if rest and (rest[-1][by].iloc[-1].to_numpy() != run[by].iloc[0].to_numpy()).any():
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
            rest.append(run)
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, whose document stands for its group; of rows with equal id and text one stays."""
    found = near_duplicates(docs, id_col, text, k, share).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("_kept"), F.xxhash64(F.col(f"`{text}`")).alias("_text"))
    known = packed.filter("_kept IS NOT NULL").join(found, "_kept", "left_semi").dropDuplicates(["_kept", "_text"])
    return known.unionByName(packed.filter("_kept IS NULL")).select("row.*")
