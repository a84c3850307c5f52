"""Periodic runs of words by recompression.

A run is a stretch of words that repeats with a smallest period q at least twice, and that no neighbouring word continues.
Texts of a batch are laid end to end, with a mark of its own before each and after the last, and are compressed together:

* block compression replaces each stretch of one repeated symbol by one symbol per (symbol, length);
* pair compression splits the symbols in two halves and replaces each pair of a left and a right symbol by one; the halves
  are drawn anew in each round, and the better of the two orders is taken.

The rounds alternate until each text is one symbol. Whether two symbols come together depends on these two only, so equal
stretches are cut alike inside, and the levels make a grammar whose symbols stand for the same words wherever they are.

``Grammar.extension`` answers how far the words from two places on (or back from them) agree, for many pairs at once: where
both places start a symbol of the next level and these symbols are equal, it climbs; where the symbols at hand are equal,
it steps over them, and over a whole block at once; else it descends, and a difference of two words ends it.

Candidates lie on the harmonic grid: a run of period q with two periods or more holds two neighbouring multiples of q, so
for each q only places kq and (k+1)q with equal words need an extension to both sides. A stretch that repeats with a
multiple of its smallest period has the same ends as with the smallest one, so of equal ends the smallest period stays.

Defined cases: words are stretches of characters other than space and U+0009..U+000D, and case counts; null and empty texts
have no runs and collapse to the empty text; repeated rows each give their result; a null id stays null; an empty table
gives an empty result; only the named columns are read, whatever other columns are called. A text is worked on in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import by_bytes, lists
from .words import words_of

#: Shortest run in words.
LEAST = 12
#: Candidates that are extended together.
CHUNK = 1 << 19
#: Bytes of text that are compressed together; a longer text is compressed alone.
BATCH = 1 << 22
ODD = 0x9E3779B97F4A7C15


class Grammar:
    """Levels of the compression, one behind the other in flat arrays; a node is a place in them."""

    def __init__(self, codes: np.ndarray, marks: np.ndarray):
        """``codes`` are symbols of the words, with one symbol of its own at each place in ``marks``."""
        sym, size = codes.astype(np.int64), np.ones(len(codes), np.int32)
        fresh, low_mark, high_mark = int(codes.max()) + 1, int(codes[marks].min()), int(codes[marks].max())
        levels, blocks, turn, base = [], [], 0, 0
        while True:
            # Which symbols start a group of the next level.
            if turn % 2 == 0:
                starts = np.concatenate([[True], sym[1:] != sym[:-1]])
            else:
                mark = (sym >= low_mark) & (sym <= high_mark)
                half = ((sym.astype(np.uint64) * np.uint64(ODD * (turn * 2 + 1) & (1 << 64) - 1)) >> np.uint64(47)) & np.uint64(1) == 1
                left, right = half & ~mark, ~half & ~mark
                one, other = left[:-1] & right[1:], right[:-1] & left[1:]
                starts = np.concatenate([[True], ~(one if one.sum() >= other.sum() else other)])
            turn += 1
            if starts.all():
                if len(sym) <= 2 * len(marks) - 1:
                    break
                continue
            first = np.flatnonzero(starts)
            ends = np.append(first[1:], len(sym))
            many = np.flatnonzero(ends - first > 1)
            names = sym[first]
            second = (ends - first)[many] if turn % 2 == 1 else sym[first[many] + 1]
            name, kinds = pd.factorize((names[many] << 32) | second)
            names[many] = fresh + name
            fresh += len(kinds)
            levels.append((sym, size, starts, first, ends, base))
            blocks.append(turn % 2 == 1)
            base += len(sym)
            sym, size = names, np.add.reduceat(size, first).astype(np.int32)
        levels.append((sym, size, None, None, None, base))
        n = base + len(sym)
        self.sym, self.size = np.empty(n, np.int32), np.empty(n, np.int32)
        self.parent, self.child, self.last_child = (np.full(n, -1, np.int32) for _ in range(3))
        self.first, self.last, self.in_block = (np.zeros(n, bool) for _ in range(3))
        for k, (sym, size, starts, first, ends, base) in enumerate(levels):
            here = slice(base, base + len(sym))
            self.sym[here], self.size[here] = sym, size
            if starts is not None:
                up = levels[k + 1][5]
                self.parent[here] = up + np.cumsum(starts) - 1
                self.first[here] = starts
                self.last[base + ends - 1] = True
                self.in_block[here] = blocks[k]
                self.child[up:up + len(first)] = base + first
                self.last_child[up:up + len(first)] = base + ends - 1

    def extension(self, u: np.ndarray, v: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from ``u`` and ``v`` on (themselves included) are equal; with ``back``, going to the left."""
        edge, down, step = (self.last, self.last_child, -1) if back else (self.first, self.child, 1)
        far = self.child if back else self.last_child
        out = np.zeros(len(u), np.int64)
        at, x, y = np.arange(len(u)), u.astype(np.int64), v.astype(np.int64)
        while len(at):
            px, py = self.parent[x], self.parent[y]
            climb = self.edge_equal(edge, x, y, px, py)
            equal = ~climb & (self.sym[x] == self.sym[y])
            e = np.flatnonzero(equal)
            if len(e):
                ex, ey = x[e], y[e]
                r = np.ones(len(e), np.int64)
                b = np.flatnonzero(self.in_block[ex])
                r[b] += np.minimum(np.abs(far[px[e[b]]] - ex[b]), np.abs(far[py[e[b]]] - ey[b]))
                out[at[e]] += self.size[ex] * r
                x[e], y[e] = ex + step * r, ey + step * r
            d = np.flatnonzero(~climb & ~equal)
            x[climb], y[climb] = px[climb], py[climb]
            x[d], y[d] = down[x[d]], down[y[d]]
            if len(d):
                going = np.ones(len(at), bool)
                going[d] = x[d] >= 0
                at, x, y = at[going], x[going], y[going]
        return out

    def edge_equal(self, edge, x, y, px, py):
        """Whether both places are at the edge of a symbol of the next level and these symbols are equal."""
        out = edge[x] & edge[y]
        k = np.flatnonzero(out)
        out[k] = self.sym[px[k]] == self.sym[py[k]]
        return out


def runs_of(codes: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """Runs of each sequence of word codes (0, 1, ...) as rows (start, length, period), by start, then period."""
    sizes = np.array([len(c) for c in codes], np.int64)
    none = np.empty((0, 3), np.int64)
    if not len(codes) or sizes.max() < max(least, 2):
        return [none] * len(codes)
    order = np.argsort(sizes, kind="stable")
    top = max(int(c.max()) for c in codes if len(c)) + 1
    parts = []
    for k, i in enumerate(order):
        parts += [np.array([top + k]), codes[i]]
    flat = np.concatenate([*parts, [top + len(order)]]).astype(np.int64)
    starts = np.cumsum(np.concatenate([[0], sizes[order] + 1])) + 1  # of each text, and one beyond
    text = np.repeat(np.arange(len(order) + 1), np.append(sizes[order] + 1, 1))
    grammar = Grammar(flat, starts - 1)
    low = flat.astype(np.int32)

    found: list[np.ndarray] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def extend() -> None:
        nonlocal held, waiting
        i, q = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        held, waiting = [], 0
        for a in range(0, len(i), CHUNK):
            u, p = i[a:a + CHUNK], q[a:a + CHUNK]
            ahead, before = grammar.extension(u, u + p), grammar.extension(u - 1, u + p - 1, back=True)
            ok = (ahead + before >= p) & (ahead + before + p >= least)
            rows = np.stack([(u - before)[ok], (u + p + ahead)[ok], p[ok]], 1)
            # Periods come in ascending order, so the first of equal ends has the smallest.
            _, one = np.unique(rows[:, 0] * len(low) + rows[:, 1], return_index=True)
            found.append(rows[np.sort(one)])

    ordered = sizes[order]
    for q in range(1, int(sizes.max()) // 2 + 1):
        begin = starts[np.searchsorted(ordered, max(2 * q, least))]
        grid = low[begin::q]
        hit = begin + q * np.flatnonzero(grid[:-1] == grid[1:])
        hit = hit[text[hit] == text[hit + q]]
        if len(hit):
            held.append((hit, np.full(len(hit), q)))
            waiting += len(hit)
            if waiting >= CHUNK:
                extend()
    if held:
        extend()
    out = [none] * len(codes)
    if not found:
        return out
    rows = np.concatenate(found)
    _, one = np.unique(rows[:, 0] * len(low) + rows[:, 1], return_index=True)
    rows = rows[np.sort(one)]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    owner = text[rows[:, 0]]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for part, k in zip(np.split(rows, cuts), owner[np.concatenate([[0], cuts])] if len(rows) else []):
        start = part[:, 0] - starts[k]
        out[order[k]] = np.stack([start, part[:, 1] - part[:, 0], part[:, 2]], 1)
    return out


def repeated(n: int, rows: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in some run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edge, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def runs(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Per row of ``df``: doc_id, runs (start, length, period; numbered in words from 0, by start, then period), and
    collapsed, the text's words without those that a run repeats, with one space between."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    fields = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]

    def batch_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "t", BATCH):
                number = defaultdict(count().__next__)
                docs = [words_of(t, lower=False) for t in part.column("t").to_pylist()]
                codes = [np.fromiter(map(number.__getitem__, d), np.int64, len(d)) for d in docs]
                got = runs_of(codes, least)
                collapsed = []
                for d, r in zip(docs, got):
                    if len(r):
                        d = [w for w, drop in zip(d, repeated(len(d), r).tolist()) if not drop]
                    collapsed.append(b" ".join(d))
                flat = np.concatenate(got) if got else np.empty((0, 3), np.int64)
                ends = lists(flat[:, 0], np.array([len(r) for r in got], np.int64)).offsets
                shown = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=[pa.field(*f) for f in fields]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), shown, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    kind = f"doc_id {dict(rows.dtypes)['doc_id']}, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(batch_runs, kind)
