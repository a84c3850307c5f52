"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from its words; the bag's is their noisy-or,
``1 - prod(1 - p)``. Only document labels are needed for training, and the sentence probabilities that come out of it
show which sentences offend. Features are words and their leading characters, so inflected forms share weight.

Training reads a sample of at most ``SAMPLE`` labelled documents of each class, drawn by the hash of the id (the bound
is a parameter). Its ids are broadcast, at most twice ``SAMPLE``; the sampled texts are stored once, the features are
ranked on them by a distributed count, and the sparse bags of the best ``FEATURES`` are fitted. Scoring is one pass
without a shuffle.

Defined cases: null and empty texts have no sentence and score 0; labels without a document or with a null value are
not used; with one class or none there is nothing to learn and every score is 0; only named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .shared import stored
from .words import CACHE_WORDS

SAMPLE = 10_000
FEATURES = 2048
PREFIXES = (4, 5, 6)
SENTENCE = re.compile(r"[^.!?\n]+")
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_PLAIN).split()


def _features(word: bytes) -> list[bytes]:
    return [b"w" + word, *(b"p" + word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass(frozen=True)
class Model:
    names: tuple[bytes, ...]
    weights: np.ndarray
    bias: float


class _Known(dict):
    """Word to the indices of its features, empty for most."""

    def __init__(self, names):
        super().__init__()
        self.at = {n: i for i, n in enumerate(names)}

    def __missing__(self, word: bytes):
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = out = tuple(self.at[f] for f in _features(word) if f in self.at)
        return out


def _bag(text: str | None, known: _Known) -> tuple[int, list[tuple[int, int, list[int]]]]:
    """Sentences with a word, and of those with known features the span and the features."""
    if not text:
        return 0, []
    hit = any(map(known.__getitem__, _words(text)))
    n, found = 0, []
    for m in SENTENCE.finditer(text):
        if not hit:
            n += not m.group().isspace()
            continue
        words = _words(m.group())
        n += bool(words)
        fs = sorted({i for w in words for i in known[w]})
        if fs:
            found.append((m.start(), m.end(), fs))
    return n, found


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_bags(bags: list[tuple[float, int, list[list[int]]]], start: np.ndarray, rounds: int = 150, rate: float = 0.1,
             ridge: float = 1e-4, bias: float = -5.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the noisy-or log loss by Adam steps over all bags; a bag is (label, sentences
    without known features, feature lists)."""
    y = np.array([b[0] for b in bags])
    rest = np.array([b[1] for b in bags], float)
    sent_bag = np.repeat(np.arange(len(bags)), [len(b[2]) for b in bags])
    lists = [s for b in bags for s in b[2]]
    row = np.repeat(np.arange(len(lists)), [len(s) for s in lists])
    col = np.array([f for s in lists for f in s], np.int64)
    w = np.append(start, bias)
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for t in range(1, rounds + 1):
        z = w[-1] + np.bincount(row, w[col], len(lists)) if len(lists) else np.zeros(0)
        p, p0 = _sigmoid(z), _sigmoid(w[-1])
        log_no = np.bincount(sent_bag, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags)) + rest * np.log1p(-p0)
        bag_p = np.clip(-np.expm1(log_no), 1e-9, 1.0)
        pull = np.where(y > 0, -(1 - bag_p) / bag_p, 1.0) * share
        gz = pull[sent_bag] * p
        g = np.append(np.bincount(col, gz[row], len(start)) + ridge * w[:-1], gz.sum() + (pull * rest).sum() * p0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def sample_ids(labels: DataFrame, id_col: str, label: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids of each class, by the order of the id's hash."""
    known = (labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_y"))
             .filter("_id IS NOT NULL AND _y IN (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y")))
    order = [F.xxhash64(F.col("_id").cast("string")), "_id"]
    one, none = (known.filter(F.col("_y") == y).orderBy(*order).limit(bound) for y in (1, 0))
    return one.unionByName(none)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
          bound: int = SAMPLE, features: int = FEATURES) -> Model:
    ids = sample_ids(labels, id_col, label, bound)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(ids), "_id")
    sample = stored(rows.select("_y", "_text"), "toxic-sample")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flushed():
            names = list(out[0].keys() | out[1].keys())
            frame = pd.DataFrame({"f": names, "pos": [out[1][x] for x in names], "neg": [out[0][x] for x in names]})
            out[0].clear()
            out[1].clear()
            return frame

        for part in parts:
            for y, t in zip(part["_y"], part["_text"]):
                out[int(y)].update({f for w in set(_words(t or "")) for f in _features(w)})
                if len(out[0]) + len(out[1]) > CACHE_WORDS:
                    yield flushed()
        yield flushed()

    sizes = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model((), np.zeros(0), -40.0)
    counts = (sample.mapInPandas(count, "f binary, pos long, neg long").groupBy("f")
              .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter("pos >= 2"))
    lift = (F.col("pos") / n1 - F.col("neg") / n0) / F.sqrt((F.col("pos") + F.col("neg") + 1) / F.lit(float(n1 + n0)))
    best = counts.select("f", "pos", "neg", lift.alias("lift")).filter("lift > 0").orderBy(F.desc("lift"), "f").limit(features).collect()
    names = tuple(bytes(r["f"]) for r in best)
    start = np.array([0.5 * np.log((r["pos"] + 0.5) / n1 / ((r["neg"] + 0.5) / n0)) for r in best])

    def bags(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known(names)
        for part in parts:
            got = [_bag(t, known) for t in part["_text"]]
            yield pd.DataFrame({"y": part["_y"].astype("float64"), "rest": [n - len(s) for n, s in got],
                                "lists": [[fs for _, _, fs in s] for _, s in got]})

    seen = sample.mapInPandas(bags, "y double, rest long, lists array<array<int>>").collect()
    w, b = fit_bags([(r["y"], max(r["rest"], 0), r["lists"]) for r in seen], start)
    return Model(names, w, b)


def scored(text: Column, model: Model, offending: float = 0.5) -> Column:
    """Struct of the document's score and its offending sentences (code points, end exclusive, probability)."""

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, w, b = _Known(model.names), model.weights, model.bias
        none = float(np.log1p(-_sigmoid(b)))
        for part in texts:
            scores, spans = [], []
            for t in part:
                n, found = _bag(t, known)
                ps = [float(_sigmoid(b + w[fs].sum())) for _, _, fs in found]
                log_no = max(n - len(found), 0) * none + sum(np.log1p(-min(p, 1 - 1e-12)) for p in ps)
                scores.append(float(-np.expm1(log_no)) + 0.0)
                spans.append([{"start": s, "end": e, "p": p} for (s, e, _), p in zip(found, ps) if p >= offending])
            yield pd.DataFrame({"score": scores, "offending": spans})

    kind = "struct<score:double,offending:array<struct<start:int,end:int,p:double>>>"
    return F.pandas_udf(score, kind).asNondeterministic()(text)
