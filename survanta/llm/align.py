"""Alignment of two tokenizers' tokens by whitespace-token anchors.

Both tokenizers encode a text whole. A byte offset where a token of both ends is shared; shared ends cut the tokens into
groups, and every token of A is linked with every token of B of its group. How often two ids are linked is counted in
documents over the whole corpus.

* Anchors are the shared ends before a token that both tokenizers start with a space. They split a text into windows, each a
  pair of id tuples, and the groups of a window depend on its two tuples only. In ordinary text a window is a word, so a
  block of documents has few different windows: they are numbered by their id tuples, aligned once each and looked up for
  every further place.
* The windows of a block of documents are stored with the documents' sequences of window numbers. Counts go the other way:
  a block sends each different id pair once, with its number of documents there; Spark adds these up, finds each A id's
  highest count and sends every block the counts of its own pairs. So neither documents nor links are shuffled by id pair, a
  frequent pair is one row per block, and nothing but blocks of bounded text is held in one task.

Encoding looks up units of text: stretches that begin with a space after a character that is no white space. No piece of B
holds a space behind another character (checked when the vocabulary is read), and the pattern of A ends a match before
such a space, so a unit has the same tokens alone as in its text. Where A's ids follow its merges, units of
Latin characters (on whose classes all versions of Unicode agree) are encoded from these ranks by the faster of the two
public BPE libraries; the ids are the same. Every unit is checked to be spelt by its tokens. A unit starts at an anchor, so
the windows of a text are those of its units, and tokens and windows are formed once per different unit of a block.

Defined cases: a text that is null or empty, or that A's or B's tokens do not spell byte for byte, has no tokens and zeros
in all numbers, with empty groups; strings of special tokens are plain text; of repeated rows each counts as a document; a
null id stays null; an empty table gives an empty result; only the named columns are read, whatever other columns are
called. A group of very many tokens is linked by its different ids and their multiplicities.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import by_bytes, packed, unpacked
from .shared import stored

#: Bytes of text of a block; a longer text is a block of its own.
BLOCK = 1 << 21
#: Places of windows whose id pairs are counted together.
PLACES = 1 << 17
UNITS_KEPT = 200_000
#: A longer unit is encoded each time.
UNIT = 256
#: The last character of the Latin blocks.
LATIN = "\u024f"
#: Groups with more links are linked by different ids.
LINKS = 1 << 14
#: White space in the sense of any of the three engines; a unit starts at a space behind something else.
WHITE = r"\s\u180e"
GPT_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed: the split of byte-level models
UNITS = re.compile(rf"[{WHITE}]*[^{WHITE}]+(?:(?! )[{WHITE}]+[^{WHITE}]*)*|[{WHITE}]+")


def byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as the characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """Ids of one tokenizer: their number type, byte lengths, first bytes and the encoding of units."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw
        self.kind = np.dtype("<u2" if len(raw) <= 1 << 16 else "<u4")
        self.length = np.array([len(r) for r in raw], np.int64)
        self.spaced = np.array([r.startswith(b" ") for r in raw])


class Pair:
    """Both tokenizers and the units met of late."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        self.tok.encode_special_tokens = True
        special = {t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        as_byte = byte_of()
        self.a = Side([names[i].encode() if i in special else bytes(map(as_byte.__getitem__, names[i])) if i in names else b"" for i in range(max(names) + 1)])
        self.sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any("▁" in p.lstrip("▁") or " " in p for p in pieces):
            raise ValueError("a piece goes on behind a space, so units have no tokens of their own")
        self.b = Side([bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.space = self.sp.piece_to_id("▁")
        self.ranked = self._ranked(spec["model"])
        #: Unit to the bytes of its ids; None where they do not spell it.
        self.kept: dict[str, tuple[bytes, bytes] | None] = {}

    def _ranked(self, model: dict):
        import tiktoken
        merges = [m.replace(" ", "", 1) if isinstance(m, str) else "".join(m) for m in model["merges"]]
        if any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merges)):
            return None
        as_byte = byte_of()
        known = [*as_byte, *merges]
        ranks = {bytes(map(as_byte.__getitem__, t)): model["vocab"][t] for t in known}
        return tiktoken.Encoding("from merges", pat_str=GPT_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        new = [u for u in units if u not in self.kept]
        gc.disable()  # many small lists come and go, none in cycles
        for i in range(0, len(new), 4096):
            self._encode(new[i:i + 4096])
        gc.enable()
        out = list(map(self.kept.__getitem__, units))
        if len(self.kept) > UNITS_KEPT:
            self.kept.clear()
        else:
            for u in [u for u in new if len(u) > UNIT]:
                del self.kept[u]
        return out

    def _encode(self, units: list[str]) -> None:
        plain = [u for u in units if self.ranked is not None and max(u) <= LATIN]
        other = [u for u in units if self.ranked is None or max(u) > LATIN]
        units = plain + other
        a = list(map(self.ranked.encode_ordinary, plain)) if plain else []
        if other:
            a += [e.ids for e in self.tok.encode_batch_fast(other, add_special_tokens=False)]
        # B puts a space before what it is given, so the unit's own first space is left to it; alone, it is a piece.
        b = self.sp.encode([u[1:] for u in units], num_threads=1)
        b = [y if u != " " else [self.space] for u, y in zip(units, b)]
        raw = [u.encode() for u in units]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        right, both = np.ones(len(units), bool), []
        for side, ids in ((self.a, a), (self.b, b)):
            flat = np.fromiter(chain.from_iterable(ids), side.kind)
            ends = np.cumsum(np.fromiter(chain([0], map(len, ids)), np.int64, len(ids) + 1))
            upto = np.concatenate([[0], np.cumsum(side.length[flat])])
            right &= np.diff(upto[ends]) == sizes
            if b"".join(map(side.raw.__getitem__, flat.tolist())) != b"".join(raw):
                right &= [b"".join(map(side.raw.__getitem__, x)) == r for x, r in zip(ids, raw)]
            data, at = flat.tobytes(), (ends * side.kind.itemsize).tolist()
            both.append(map(data.__getitem__, map(slice, at, at[1:])))
        self.kept.update(zip(units, zip(*both)))
        self.kept.update((units[i], None) for i in np.flatnonzero(~right))

    def units(self, texts: list[str]) -> tuple[list[np.ndarray], list[tuple[bytes, bytes]]]:
        """The different units of the texts as pairs of ids, and each text's units by number; none where tokens do not spell
        the text."""
        number: dict[str, int] = defaultdict(count().__next__)
        seqs = [np.fromiter(map(number.__getitem__, UNITS.findall(" " + t)), np.int64) if t else np.empty(0, np.int64) for t in texts]
        ids = self.ids(list(number))
        bad = np.array([i for i, x in enumerate(ids) if x is None], np.int64)
        if len(bad):
            seqs = [q if not np.isin(bad, q).any() else q[:0] for q in seqs]
        return seqs, [x or (b"", b"") for x in ids]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Both sides' ids of each text as bytes; none where they do not spell it."""
        seqs, ids = self.units(texts)
        return tuple([b"".join([ids[i][s] for i in q.tolist()]) for q in seqs] for s in (0, 1))


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def shared_ends(own: Pair, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` whose tokens end at the same byte."""
    x, y = np.cumsum(own.a.length[a]), np.cumsum(own.b.length[b])
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = np.flatnonzero(y[at] == x) if len(y) else np.empty(0, np.int64)
    return same, at[same]


def windows(own: Pair, a_texts: list[bytes], b_texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, bytes]]]:
    """Number of windows of each text, the windows' numbers one text after the other, and the windows by number."""
    a, b = np.frombuffer(b"".join(a_texts), own.a.kind), np.frombuffer(b"".join(b_texts), own.b.kind)
    number: dict[tuple[bytes, bytes], int] = defaultdict(count().__next__)
    if not len(a):
        return np.zeros(len(a_texts), np.int32), np.empty(0, np.uint32), []
    text_ends = np.cumsum([len(t) // own.a.kind.itemsize for t in a_texts])
    i, j = shared_ends(own, a, b)
    last = np.zeros(len(a), bool)
    last[text_ends[text_ends > 0] - 1] = True
    after_a, after_b = np.minimum(i + 1, len(a) - 1), np.minimum(j + 1, len(b) - 1)
    anchor = last[i] | (own.a.spaced[a[after_a]] & own.b.spaced[b[after_b]])
    i, j = i[anchor] + 1, j[anchor] + 1
    ab, bb, sa, sb = a.tobytes(), b.tobytes(), own.a.kind.itemsize, own.b.kind.itemsize
    ai, bj = (i * sa).tolist(), (j * sb).tolist()
    seq = np.fromiter((number[ab[p:q], bb[r:s]] for p, q, r, s in zip([0, *ai[:-1]], ai, [0, *bj[:-1]], bj)), np.uint32, len(ai))
    before = np.searchsorted(i, text_ends, side="right")
    return np.diff(before, prepend=0).astype(np.int32), seq, list(number)


def expanded(texts: list[np.ndarray], of_unit: np.ndarray, unit_seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of windows and the windows' numbers of each text, from its units and theirs."""
    flat = np.concatenate(texts) if texts else np.empty(0, np.int64)
    per = of_unit[flat].astype(np.int64) if len(flat) else np.empty(0, np.int64)
    begin = np.cumsum(of_unit, dtype=np.int64) - of_unit
    at = np.repeat((begin[flat] if len(flat) else per) - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
    upto, ends = np.concatenate([[0], np.cumsum(per)]), np.cumsum([len(t) for t in texts]).astype(np.int64)
    return np.diff(upto[ends], prepend=0).astype(np.int32), unit_seq[at].astype(np.uint32)


class Aligned:
    """Groups and links of each of a list of windows, and the different id pairs with their multiplicities."""

    def __init__(self, own: Pair, a_sizes: np.ndarray, a: np.ndarray, b_sizes: np.ndarray, b: np.ndarray):
        self.own, self.n, self.a_sizes, self.b_sizes = own, len(a_sizes), a_sizes, b_sizes
        self.a, self.b = a.astype(np.int64), b.astype(np.int64)
        i, j = shared_ends(own, self.a, self.b)
        self.a_ends, self.b_ends = i + 1, j + 1
        self.n_a, self.n_b = np.diff(self.a_ends, prepend=0), np.diff(self.b_ends, prepend=0)
        self.window = np.searchsorted(np.cumsum(a_sizes), self.a_ends)  # of each group
        self.n_groups = np.bincount(self.window, minlength=self.n)
        self.links = self.n_a * self.n_b
        self.base = len(own.b.raw)
        self._pairs()

    def _pairs(self) -> None:
        small = np.flatnonzero(self.links <= LINKS)
        n_a, n_b, links = self.n_a[small], self.n_b[small], self.links[small]
        group = np.repeat(np.arange(len(small)), links)
        k = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
        ia = np.repeat(self.a_ends[small] - n_a, links) + k // n_b[group]
        ib = np.repeat(self.b_ends[small] - n_b, links) + k % n_b[group]
        owner, code, times = [self.window[small][group]], [self.a[ia] * self.base + self.b[ib]], [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(self.links > LINKS):
            xa, na = np.unique(self.a[self.a_ends[g] - self.n_a[g]:self.a_ends[g]], return_counts=True)
            xb, nb = np.unique(self.b[self.b_ends[g] - self.n_b[g]:self.b_ends[g]], return_counts=True)
            code.append((xa[:, None] * self.base + xb).ravel())
            times.append((na[:, None] * nb).ravel())
            owner.append(np.full(len(code[-1]), self.window[g]))
        owner, code, times = np.concatenate(owner), np.concatenate(code), np.concatenate(times)
        order = np.lexsort((code, owner))
        owner, code, times = owner[order], code[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])) if len(code) else np.empty(0, np.int64)
        #: One entry per window and different id pair, by window.
        self.owner, self.code = owner[first], code[first]
        self.times = np.add.reduceat(times, first) if len(first) else times

    def documents_of_pairs(self, sizes: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Different id pairs and how many texts hold each; ``sizes`` and ``seq`` are the texts' windows."""
        starts = np.searchsorted(self.owner, np.arange(self.n + 1))
        code, place = np.unique(self.code, return_inverse=True)
        total, ends = np.zeros(len(code), np.int64), np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            begin = ends[first] - sizes[first]
            stop = max(int(np.searchsorted(ends, begin + PLACES, side="right")), first + 1)
            seen = np.unique(np.repeat(np.arange(stop - first), sizes[first:stop]) * max(self.n, 1) + seq[begin:ends[stop - 1]])
            text, window = np.divmod(seen, max(self.n, 1))
            per = starts[window + 1] - starts[window]
            at = np.repeat(starts[window] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
            held = np.unique(np.repeat(text, per) * max(len(code), 1) + place[at])
            total += np.bincount(held % max(len(code), 1), minlength=len(code))
            first = stop
        return code, total

    def shown(self) -> list[str]:
        """The groups of each window as text: ids of A, a bar, ids of B, with commas within and semicolons behind a group."""
        width = self.n_a + self.n_b
        begin = np.cumsum(width) - width
        flat, mark = np.empty(int(width.sum()), np.int64), np.zeros(int(width.sum()), np.int64)
        within_a, within_b = np.arange(len(self.a)), np.arange(len(self.b))
        flat[np.repeat(begin - (self.a_ends - self.n_a), self.n_a) + within_a] = self.a
        flat[np.repeat(begin + self.n_a - (self.b_ends - self.n_b), self.n_b) + within_b] = self.b
        mark[begin + self.n_a - 1], mark[begin + width - 1] = 1, 2
        size = max(len(self.own.a.raw), len(self.own.b.raw))
        told = list(map(_marked(size).__getitem__, (mark * size + flat).tolist()))
        ends = np.cumsum(np.bincount(self.window, width, self.n)).astype(np.int64).tolist()
        return ["".join(told[p:q])[:-1] for p, q in zip([0, *ends[:-1]], ends)]


@lru_cache(maxsize=2)
def _marked(size: int) -> list[str]:
    return [f"{i}{m}" for m in ",|;" for i in range(size)]


def _block_schema(id_kind: str) -> str:
    return f"block long, doc_id array<{id_kind}>, sizes binary, seq binary, a_sizes binary, a binary, b_sizes binary, b binary"


def blocks(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of documents: their ids, each one's sequence of window numbers, and the windows."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        own, block = pair(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in by_bytes(batch, "t", BLOCK):
                texts, ids = own.units(part.column("t").to_pylist())
                of_unit, unit_seq, known = windows(own, [x for x, _ in ids], [y for _, y in ids])
                sizes, seq = expanded(texts, of_unit, unit_seq)
                # Frequent windows have small numbers, which pack well.
                order = np.argsort(-np.bincount(seq, minlength=len(known)), kind="stable")
                rank = np.empty(len(known), np.uint32)
                rank[order] = np.arange(len(known), dtype=np.uint32)
                seq, known = rank[seq], [known[i] for i in order.tolist()]
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id"))
                flat = [np.frombuffer(b"".join([k[i] for k in known]), side.kind) for i, side in enumerate((own.a, own.b))]
                held = [np.array([len(k[i]) // side.kind.itemsize for k in known], np.int32) for i, side in enumerate((own.a, own.b))]
                row = [pa.array([packed(x)], pa.binary()) for x in (sizes, seq, held[0], flat[0], held[1], flat[1])]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), ids, *row], ["block", "doc_id", "sizes", "seq", "a_sizes", "a", "b_sizes", "b"])
                block += 1

    return rows.mapInArrow(make, _block_schema(dict(rows.dtypes)["doc_id"]))


def _opened(own: Pair, row: dict) -> tuple[np.ndarray, np.ndarray, Aligned]:
    aligned = Aligned(own, unpacked(row["a_sizes"], np.int32), unpacked(row["a"], own.a.kind), unpacked(row["b_sizes"], np.int32), unpacked(row["b"], own.b.kind))
    return unpacked(row["sizes"], np.int32), unpacked(row["seq"], np.uint32).astype(np.int64), aligned


def block_pairs(kept: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per block and id pair linked there: how many of the block's documents hold it."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(a_path, b_path)
        for batch in batches:
            for row in batch.to_pylist():
                sizes, seq, aligned = _opened(own, row)
                code, n = aligned.documents_of_pairs(sizes, seq)
                a, b = np.divmod(code, aligned.base)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), row["block"])), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n)],
                                                 ["block", "a", "b", "n_docs"])

    return kept.select("block", "sizes", "seq", "a_sizes", "a", "b_sizes", "b").mapInArrow(make, "block long, a int, b int, n_docs long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Per id pair: n_docs over all blocks, and whether no other pair of the same A id has more."""
    totals = pairs.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"))
    return totals.join(totals.groupBy("a").agg(F.max("n_docs").alias("most")), "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups as text, ``a1,a2|b1;a3|b2``."""
    kept = stored(blocks(df, a_path, b_path, id_col, text), "token-windows")
    pairs = stored(block_pairs(kept, a_path, b_path), "token-pairs")
    counted = pairs.select("block", "a", "b").join(pair_counts(pairs), ["a", "b"])
    id_kind = dict(kept.dtypes)["doc_id"].removeprefix("array<").removesuffix(">")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def apply(block: pa.Table, counts: pa.Table) -> pa.Table:
        own = pair(a_path, b_path)
        row = block.to_pylist()[0]
        sizes, seq, aligned = _opened(own, row)
        code = counts.column("a").to_numpy().astype(np.int64) * aligned.base + counts.column("b").to_numpy()
        order = np.argsort(code)
        at = order[np.searchsorted(code, aligned.code, sorter=order)] if len(code) else np.empty(0, np.int64)
        n_docs, best = counts.column("n_docs").to_numpy()[at], counts.column("best").to_numpy(zero_copy_only=False)[at].astype(np.int64)
        total = lambda owner, values: np.bincount(owner, values, aligned.n).astype(np.int64)
        exact = lambda owner, values: _sums(owner, values, aligned.n)
        per = [aligned.a_sizes, aligned.b_sizes, aligned.n_groups,
               total(aligned.window, aligned.links), total(aligned.owner, aligned.times * best), exact(aligned.owner, aligned.times * n_docs)]
        ends = np.cumsum(sizes)
        shown = aligned.shown()
        told = list(map(shown.__getitem__, seq.tolist()))
        groups = [";".join(told[e - s:e]) for s, e in zip(sizes.tolist(), ends.tolist())]
        columns = [np.diff(np.concatenate([[0], np.cumsum(p.astype(np.int64)[seq])])[ends], prepend=0) for p in per]
        return pa.table([block.column("doc_id").combine_chunks().flatten(), *[pa.array(c.astype(np.int64)) for c in columns], pa.array(groups, pa.string())],
                        ["doc_id", *numbers, "groups"])

    kind = f"doc_id {id_kind}, {', '.join(f'{n} long' for n in numbers)}, groups string"
    return kept.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(apply, kind)


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Integer sums by owner, which comes in ascending order; exact where floats would not be."""
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.searchsorted(owner, np.arange(n + 1))
    return upto[ends[1:]] - upto[ends[:-1]]
