"""Byte-level BPE encoding and decoding by monoid tree reduction.

The encoding of a text is an element of a monoid: two neighbouring elements join into the element of the joined text, the
empty text is neutral, and the join does not depend on the order in which a tree applies it. A text is cut in halves until
a leaf has ``LEAF`` characters or fewer, leaves are encoded on their own, and neighbours join upwards. There are two levels:

* ``Pieces``: the matches of the split pattern. A match is found from left to right and looks at most two characters
  beyond its own end ("'" may become "'re", white space asks what follows it), so more text to the right can change the
  last ``OPEN`` matches of an element only. A join matches anew from before these over a window of the right half that
  doubles until a certain match ends where one of the right half's matches ends too; from there on the same text is read
  from the same place, so everything beyond stays.
* ``Tokens``: ids within one match longer than ``PIECE`` characters. A sequence of tokens is the BPE encoding exactly if
  each two neighbours are the encoding of their own bytes: the first merge across a border would happen between these two
  alone as well, since merges elsewhere do not touch it. A join encodes a window around the border anew and doubles it
  until its outer tokens are those that stood there; then every pair is certified.

Decoding maps ids to bytes and concatenates them up the same tree, which is plain concatenation.

Texts longer than ``SPAN`` characters are cut into spans that other tasks encode; the spans' elements meet by row and are
joined there. Single matches are encoded by the tiktoken library; a worker keeps those it has met, up to a bound.

Defined cases: null and empty texts have no ids and decode to no bytes; nothing is a special token; repeated rows each
give their result; a null id stays null; an empty table gives an empty result; only the named columns are read, whatever
other columns are called.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from .batches import by_bytes, lists

LEAF = 8192
PIECE = 512
SPAN = 1 << 16
#: Matches at an element's end that further text can change.
OPEN = 2
KEPT = 500_000
CLASSES = {r"\p{L}": "x", r"\p{N}": "1", r"\s": "\t"}
OTHER = "."


def tree(leaves: list, join: Callable, empty):
    """Joins neighbours, then neighbours of these, until one element is left."""
    while len(leaves) > 1:
        leaves = [join(*leaves[i:i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else empty


class Splitter:
    """Matches of the pattern, as the library's own expression engine finds them.

    ``regex`` and that engine may know different versions of Unicode. A character on whose class they differ is replaced,
    for matching only, by one of the class that the library's engine gives it.
    """

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern)
        single = {bytes([i]): i for i in range(256)}
        self.theirs = {c: tiktoken.Encoding(c, pat_str=c, mergeable_ranks=single, special_tokens={}) for c in CLASSES}
        self.ours = {c: regex.compile(c) for c in CLASSES}
        self.known: set[str] = set()
        self.fix: dict[int, str] = {}

    def learn(self, chars: set[str]) -> None:
        text = "".join(chars)
        want = {c: set(bytes(e.encode_ordinary(text)).decode()) for c, e in self.theirs.items()}
        have = {c: set(r.findall(text)) for c, r in self.ours.items()}
        for ch in chars:
            if any((ch in want[c]) != (ch in have[c]) for c in CLASSES):
                self.fix[ord(ch)] = next((x for c, x in CLASSES.items() if ch in want[c]), OTHER)
        self.known |= chars

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.find.findall(text)
        new = set(text) - self.known
        if new:
            self.learn(new)
        if self.fix and (plain := text.translate(self.fix)) != text:
            return [text[m.start():m.end()] for m in self.find.finditer(plain)]
        return self.find.findall(text)


class Codec:
    """Elements of both levels for one file of ranks and one pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = Splitter(pattern)
        self.whole = tiktoken.Encoding("one piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = dict(zip(ranks.values(), ranks))
        self.kept: dict[str, list[int]] = {}

    # ids of one match

    def tokens_joined(self, left: list[int], right: list[int]) -> list[int]:
        n = 1
        while True:
            a, b = min(n, len(left)), min(n, len(right))
            got = self._encoded(b"".join(map(self.bytes_of.__getitem__, left[len(left) - a:] + right[:b])))
            if got and (a == len(left) or got[0] == left[-a]) and (b == len(right) or got[-1] == right[b - 1]):
                return left[:len(left) - a] + got + right[b:]
            if a == len(left) and b == len(right):
                return got
            n *= 2

    def _encoded(self, raw: bytes) -> list[int]:
        try:
            return self.whole.encode_ordinary(raw.decode())
        except UnicodeDecodeError:  # the window ends inside a character, so it has to grow
            return []

    def ids_of_match(self, match: str) -> list[int]:
        if len(match) <= PIECE:
            return self.whole.encode_ordinary(match)
        return tree([self.whole.encode_ordinary(match[i:i + PIECE]) for i in range(0, len(match), PIECE)], self.tokens_joined, [])

    # matches of a text

    def pieces_joined(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left or right
        sure = max(0, len(left) - OPEN)
        tail, n = "".join(left[sure:]), 4
        while True:
            head = right[:n]
            got = self.split(tail + "".join(head))
            if n >= len(right):
                return left[:sure] + got
            ours = {e: i for i, e in enumerate(accumulate(map(len, head), initial=len(tail)))}
            for i, e in enumerate(accumulate(map(len, got[:len(got) - OPEN]), initial=0)):
                if e in ours:
                    return left[:sure] + got[:i] + right[ours[e]:]
            n *= 2

    def pieces(self, text: str) -> list[str]:
        return tree([self.split(text[i:i + LEAF]) for i in range(0, len(text), LEAF)], self.pieces_joined, [])

    # texts

    def know(self, pieces: set[str]) -> None:
        for p in pieces:
            if p not in self.kept:
                self.kept[p] = self.ids_of_match(p)

    def encode(self, docs: list[list[str]]) -> list[list[int]]:
        """Ids of texts whose matches are given."""
        for d in docs:
            self.know(set(d))
        out = [list(chain.from_iterable(map(self.kept.__getitem__, d))) for d in docs]
        if len(self.kept) > KEPT:
            self.kept.clear()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _columns(own: Codec, docs: list[list[str]]) -> tuple[pa.Array, pa.Array]:
    ids = own.encode(docs)
    sizes = np.array([len(i) for i in ids], np.int64)
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
    return lists(flat, sizes), pa.array([own.decode(i) for i in ids], pa.binary())


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """Per row of ``df``: doc_id, ids, and decoded, the bytes that the ids decode to."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    id_kind = dict(rows.dtypes)["doc_id"]
    kind = f"doc_id {id_kind}, ids array<int>, decoded binary"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in by_bytes(batch, "t", 1 << 22):
                ids, decoded = _columns(own, [own.pieces(t) for t in part.column("t").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, decoded], ["doc_id", "ids", "decoded"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in by_bytes(batch, "t", 1 << 22):
                pieces = [own.pieces(t) for t in part.column("t").to_pylist()]
                ids = [own.encode([[p] for p in d]) for d in pieces]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("span"), pa.array(pieces, pa.list_(pa.string())),
                     pa.array(ids, pa.list_(pa.list_(pa.int32())))],
                    ["row", "doc_id", "span", "pieces", "own"])

    def meet(table: pa.Table) -> pa.Table:
        own = codec(path, pattern)
        table = table.sort_by("span")
        pieces = table.column("pieces").to_pylist()
        for d, ids in zip(pieces, table.column("own").to_pylist()):
            own.kept.update(zip(d, ids))
        ids, decoded = _columns(own, [tree(pieces, own.pieces_joined, [])])
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "ids": ids, "decoded": decoded})

    short = rows.filter(F.length("t") <= span).mapInArrow(whole, kind)
    at = F.sequence(F.lit(0), F.floor((F.length("t") - 1) / span).cast("int"))
    long = rows.filter(F.length("t") > span).withColumn("row", F.monotonically_increasing_id())
    cuts = long.select("row", "doc_id", F.posexplode(F.transform(at, lambda i: F.substring("t", i * span + 1, F.lit(span)))).alias("span", "t"))
    # As many tasks as the session shuffles to, so that the spans of one long text go to many.
    dealt = cuts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row", "span")
    done = dealt.mapInArrow(spans, f"row long, doc_id {id_kind}, span int, pieces array<string>, own array<array<int>>")
    return short.unionByName(done.groupBy("row").applyInArrow(meet, kind))
