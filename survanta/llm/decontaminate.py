"""Benchmark decontamination by greedy string tiling.

Windows of ``MIN_MATCH`` words of benchmark items are the seeds, hashed by Karp-Rabin; runs of seeds on one diagonal
are maximal matches. For a document and an item that share seeds, the longest match whose words are still unmarked is
marked as a tile, again and again, until none of ``MIN_MATCH`` words is left. The share of the item under tiles does
not depend on the order of its passages, so shuffled copies are found as well.

The benchmark travels to the documents in blocks of at most ``BLOCK_WORDS`` words, so what is broadcast is bounded
however large the benchmark is, and no document is shuffled.

Defined cases: null or empty texts and items have no words and match nothing; an item of fewer than ``MIN_MATCH`` words
is one seed of its own length; ties between tiles go to the earlier place in the document, then in the item; repeated
rows each give their own result; empty tables give an empty result; only named columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .words import WordCodes, windows, words_of

MIN_MATCH = 5
THRESHOLD = 0.5
BLOCK_WORDS = 1_000_000
_BITS = 22


def tiles(pairs_doc: np.ndarray, pairs_item: np.ndarray, k: int, doc_len: int, item_len: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document place, item place, words) from seed pairs of ``k`` equal words."""
    diag = pairs_doc - pairs_item
    order = np.lexsort((pairs_doc, diag))
    d, p = diag[order], pairs_doc[order]
    cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)])
    ends = np.r_[cut[1:], len(p)]
    heap = [(-int(e - s - 1 + k), int(p[s]), int(p[s] - d[s])) for s, e in zip(cut, ends)]
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(doc_len, bool), np.zeros(item_len, bool)
    out = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        taken = in_doc[a:a + n] | in_item[b:b + n]
        if not taken.any():
            in_doc[a:a + n] = True
            in_item[b:b + n] = True
            out.append((a, b, n))
            continue
        edges = np.flatnonzero(np.diff(np.r_[1, taken.astype(np.int8), 1]))
        for s, e in zip(edges[::2], edges[1::2]):
            if e - s >= least:
                heapq.heappush(heap, (-int(e - s), a + int(s), b + int(s)))
    return out


class Seeds:
    """Seeds of one block of items, by window length."""

    def __init__(self, items: list[tuple[object, np.ndarray]], least: int):
        self.items = items
        by_k: dict[int, list] = defaultdict(list)
        for i, (_, codes) in enumerate(items):
            k = min(least, len(codes))
            if k:
                h = windows(codes, k)
                by_k[k].append((h, np.full(len(h), i), np.arange(len(h))))
        self.least, self.by_k = least, {}
        for k, parts in by_k.items():
            h, item, pos = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << _BITS, bool)
            table[h & np.uint64((1 << _BITS) - 1)] = True
            self.by_k[k] = h[order], item[order], pos[order], table

    def pairs(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(item, window length, document places, item places) of each item that shares a seed."""
        for k, (h, item, pos, table) in self.by_k.items():
            w = windows(codes, k)
            at = np.flatnonzero(table[w & np.uint64((1 << _BITS) - 1)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(h, w[at], "left"), np.searchsorted(h, w[at], "right")
            n = hi - lo
            if not n.any():
                continue
            place = np.repeat(at, n)
            row = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            order = np.argsort(item[row], kind="stable")
            place, row = place[order], row[order]
            cut = np.flatnonzero(np.r_[True, np.diff(item[row]) != 0])
            for s, e in zip(cut, np.r_[cut[1:], len(row)]):
                yield int(item[row[s]]), k, place[s:e], pos[row[s:e]]


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id",
             item_text: str = "text", least: int = MIN_MATCH, threshold: float = THRESHOLD,
             block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per document row and item whose coverage reaches ``threshold``: ids, item_words, covered, n_tiles, longest, coverage,
    and the tiles as (document word, item word, words)."""
    bench = items.select(F.col(f"`{item_col}`").alias("item"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("t"))
    item_kind = dict(bench.dtypes)["item"]
    id_kind = dict(docs.select(F.col(f"`{id_col}`").alias("doc_id")).dtypes)["doc_id"]
    kind = (f"doc_id {id_kind}, item_id {item_kind}, item_words long, covered long, n_tiles long, longest long, coverage double,"
            " tiles array<struct<doc:int,item:int,n:int>>")
    size = bench.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(size / 2 / block_words))  # a word and its space take two characters at least
    out = None
    for b in range(blocks):
        part = bench.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b) if blocks > 1 else bench
        codes = WordCodes()
        seeds = docs.sparkSession.sparkContext.broadcast(Seeds([(r["item"], codes.of(words_of(r["t"]))) for r in part.toLocalIterator()], least))

        def tile(parts: Iterator[pd.DataFrame], seeds=seeds) -> Iterator[pd.DataFrame]:
            codes, s = WordCodes(), seeds.value
            for part in parts:
                rows = []
                for doc, t in zip(part["doc_id"], part["t"]):
                    c = codes.of(words_of(t))
                    if not len(c):
                        continue
                    for i, k, dp, ip in s.pairs(c):
                        item, own = s.items[i]
                        got = tiles(dp, ip, k, len(c), len(own), k)
                        covered = sum(n for _, _, n in got)
                        if covered >= threshold * len(own):
                            rows.append((doc, item, len(own), covered, len(got), max(n for _, _, n in got), covered / len(own),
                                         [{"doc": a, "item": x, "n": n} for a, x, n in sorted(got)]))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item_words", "covered", "n_tiles", "longest", "coverage", "tiles"])

        one = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInPandas(tile, kind)
        out = one if out is None else out.unionByName(one)
    return out


def _clean(seeds, threshold: float):
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codes, s = WordCodes(), seeds.value
        for part in texts:
            got = []
            for t in part:
                c = codes.of(words_of(t))
                found = (sum(n for _, _, n in tiles(dp, ip, k, len(c), len(s.items[i][1]), k)) / len(s.items[i][1]) for i, k, dp, ip in s.pairs(c))
                got.append(not any(x >= threshold for x in found) if len(c) else True)
            yield pd.Series(got, dtype=bool)
    return clean


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", least: int = MIN_MATCH,
               threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item reaches ``threshold``; judged in place, without a shuffle."""
    bench = items.select(F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("t"))
    size = bench.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(size / 2 / BLOCK_WORDS))
    out = docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("t"))
    for b in range(blocks):
        part = bench.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b) if blocks > 1 else bench
        codes = WordCodes()
        seeds = docs.sparkSession.sparkContext.broadcast(Seeds([(None, codes.of(words_of(r["t"]))) for r in part.toLocalIterator()], least))

        out = out.filter(F.pandas_udf(_clean(seeds, threshold), "boolean").asNondeterministic()(F.col("t")))
    return out.select("row.*")
