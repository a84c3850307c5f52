"""BPE encoding by tree concatenation, and decoding.

A text is cut into leaves of ``LEAF`` characters at whatever place that is, the leaves are encoded on their own, and
neighbours are joined in a tree. A join takes the last units of the left and the first of the right half, encodes their
text anew, and doubles this window until its first unit is the left half's and its last the right half's again; then
both sides agree and the middle is replaced. The same join works on two levels:

* units of a text are runs between spaces and line ends. The tokenizer's normaliser and splitter never look across
  them, so a unit that came out as before proves that everything beyond it stays.
* units of a run longer than ``PIECE`` bytes that the splitter leaves whole are single tokens. A sequence of tokens is
  the BPE encoding exactly if each adjacent pair is the encoding of its own text (merge rules are one to one with
  tokens), so a window whose outer tokens are unchanged leaves every pair certified.

Encoding of a unit is the tokenizers library's own; a worker keeps units it has met, up to a bound. Texts longer than
``SPAN`` characters are cut into spans that other tasks encode; their encodings meet again by id and are joined there.

Defined cases: null and empty texts have no tokens; strings of special tokens in a text become these tokens, as in the
library; repeated rows each give their result; only named columns are read.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer, models

LEAF = 4096
PIECE = 512
SPAN = 1 << 16
UNITS_KEPT = 400_000
BATCH_UNITS = 4096
MARKS = ".,;:!?"
WORD_MARK = re.compile(f"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{MARKS}]?)").fullmatch
#: Byte-level models write the bytes that are no printable Latin-1 character as the characters from 256 on.
BYTE_CHARS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: Stands after the last token of a run, so that a window knows that it reaches the end.
END = ("", -1)


def joined(left: list, right: list, encode: Callable[[list, list], list]) -> list:
    """Joins two lists of units. ``encode`` gives the units of the text that the last units of the left and the first of
    the right list make together."""
    n = 1
    while left and right:
        a, b = min(n, len(left)), min(n, len(right))
        window = encode(left[-a:], right[:b])
        left_ok = a == len(left) or bool(window) and window[0] == left[-a]
        right_ok = b == len(right) or bool(window) and window[-1] == right[b - 1]
        if left_ok and right_ok:
            return left[:len(left) - a] + window + right[b:]
        n *= 2
    return left or right


def tree(leaves: list[list], encode: Callable[[list, list], list]) -> list:
    """Joins neighbours, then neighbours of these, until one list is left."""
    while len(leaves) > 1:
        leaves = [joined(leaves[i], leaves[i + 1], encode) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else []


class Encoder:
    """Units of texts with their ids, for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        shared = {"vocab": model["vocab"], "merges": merges}
        if model.get("unk_token"):
            shared["unk_token"] = model["unk_token"]
        self.shared = shared
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters_apart = self._splits_marks()
        self.plain = not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
        #: Units with their ids as little-endian bytes: those of late, and those of a while ago.
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tokens = {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()}

    def decode(self, ids: list[int]) -> str:
        """As the library's decode with special tokens; without a decoder that is the tokens with spaces between."""
        if self.tok.decoder is None:
            return " ".join(map(self.tokens.__getitem__, ids))
        return self.tok.decode(ids, skip_special_tokens=False)

    def _splits_marks(self) -> bool:
        """Whether case is dropped, marks behind a word are pieces of their own, and a word is one run of byte characters
        for the model, as far as examples show."""
        one = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        bare = lambda w: self.final.encode(w.lower().encode().decode("latin-1").translate(BYTE_CHARS), add_special_tokens=False).ids
        words = ("a", "B", "Word", "the", "ß", "Ünique", "ÀÉñ", "à")
        return all(one(w + m) == bare(w) + (one(m) if m else []) for w in words for m in ("", *MARKS))

    @cached_property
    def inner(self) -> Tokenizer:
        """The bare model for a run that goes on."""
        return Tokenizer(models.BPE(**self.shared))

    @cached_property
    def final(self) -> Tokenizer:
        """The bare model for a run that ends."""
        return Tokenizer(models.BPE(**self.shared, **({"end_of_word_suffix": self.suffix} if self.suffix else {})))

    def ids_of_piece(self, piece: str) -> list[int]:
        """One run that the splitter leaves whole, in the model's own characters, by its own tree."""
        def units(text: str, last: bool) -> list[tuple[str, int]]:
            e = (self.final if last else self.inner).encode(text, add_special_tokens=False)
            return [(text[s:t], i) for (s, t), i in zip(e.offsets, e.ids)]

        def window(left: list, right: list) -> list:
            text = "".join(u[0] for u in left + right)
            return units(text, True) + [right[-1]] if right[-1] == END else units(text, False)

        cuts = range(0, len(piece), PIECE)
        leaves = [units(piece[c:c + PIECE], c + PIECE >= len(piece)) for c in cuts]
        leaves[-1] = leaves[-1] + [END]
        return [i for t, i in tree(leaves, window) if t]

    def _ids(self, unit: str) -> tuple[int, ...]:
        """A unit longer than ``PIECE``: special tokens, normaliser and splitter of the library, then the model by tree."""
        out: list[int] = []
        rest = [(unit, None)]
        for s in self.special:
            rest = [x for text, sid in rest for x in (_around(text, s, self.special_ids[s]) if sid is None else [(text, sid)])]
        for text, sid in rest:
            if sid is not None:
                out.append(sid)
                continue
            text = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
            pieces = self.tok.pre_tokenizer.pre_tokenize_str(text) if self.tok.pre_tokenizer else [(text, None)]
            for piece, _ in pieces:
                if piece:
                    out.extend(self.ids_of_piece(piece) if self.plain else self.tok.model.tokenize(piece))
        return tuple(out)

    def forget(self) -> None:
        """Between texts: what was not met lately goes, so that a worker's memory stays bounded."""
        if len(self.kept) > UNITS_KEPT:
            self.kept, self.old = {}, self.kept

    def know(self, units: set[str]) -> None:
        """Encodes the units that are not kept yet, in batches."""
        kept, old = self.kept, self.old
        new = units.difference(kept)
        if old:
            # Looked up one by one: an intersection of a set with a dict would walk the whole dict at every join.
            again = {u for u in new if u in old}
            kept.update((u, old[u]) for u in again)
            new -= again
        if not new:
            return
        if self.letters_apart:
            # A word of Latin-1 letters with one mark behind it is two pieces, so the word without case and the mark are
            # enough, and the word is one run for the model alone.
            split = [(u, m[1].lower(), m[2]) for u in new if (m := WORD_MARK(u))]
            words = {w for _, w, _ in split if w not in kept}
            self._encode(self.final, list(words), [w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_CHARS) for w in words])
            self._encode(self.tok, list(rest := new.difference([u for u, _, _ in split]).union(MARKS).difference(kept)), list(rest))
            kept.update([(u, kept[w] + kept[x] if x else kept[w]) for u, w, x in split])
        else:
            self._encode(self.tok, list(new), list(new))

    def _encode(self, tok: Tokenizer, units: list[str], texts: list[str]) -> None:
        long = [i for i, t in enumerate(texts) if len(t) > PIECE]
        if long:
            self.kept.update((units[i], np.array(self._ids(units[i]), "<u4").tobytes()) for i in long)
            units, texts = zip(*[(u, t) for u, t in zip(units, texts) if len(t) <= PIECE]) if len(long) < len(units) else ((), ())
        for i in range(0, len(units), BATCH_UNITS):
            got = [e.ids for e in tok.encode_batch_fast(texts[i:i + BATCH_UNITS], add_special_tokens=False)]
            ends = (np.cumsum([0, *map(len, got)]) * 4).tolist()
            flat = np.fromiter(chain.from_iterable(got), "<u4", ends[-1] // 4).tobytes()
            self.kept.update(zip(units[i:i + BATCH_UNITS], map(flat.__getitem__, map(slice, ends, ends[1:]))))

    def ids(self, units: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.kept.__getitem__, units)), "<u4")


def _around(text: str, s: str, sid: int):
    bits = text.split(s)
    for i, b in enumerate(bits):
        if i:
            yield s, sid
        if b:
            yield b, None


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
    out = Encoder(path)
    gc.freeze()  # the vocabulary stays; the collector need not walk it again and again
    return out


def cut(text: str) -> list[str]:
    """Units of a text: what stands between spaces and line ends."""
    return text.replace("\n", " ").split(" ")


def leaves_of(text: str) -> list[list[str]]:
    return [cut(text[i:i + LEAF]) for i in range(0, max(len(text), 1), LEAF)]


def joined_units(enc: Encoder, leaves: list[list[str]]) -> list[str]:
    """The units of a text from those of its leaves, which ``enc`` knows; the touching ones are encoded together."""
    def window(left: list[str], right: list[str]) -> list[str]:
        units = cut(" ".join(left) + " ".join(right))
        enc.know(set(units))
        return units
    return tree(leaves, window)


def encoded_texts(enc: Encoder, texts: list[str | None]) -> list[list[str]]:
    """Units of each text; their ids and decoded forms are then in ``enc.kept``."""
    leaves = [leaves_of(t or "") for t in texts]
    enc.forget()  # here only: until the texts are done, their units stay
    enc.know({u for ls in leaves for units in ls for u in units})
    return [joined_units(enc, ls) for ls in leaves]


def _lists(enc: Encoder, docs: list[list[str]]) -> tuple[pa.Array, list[str]]:
    got = [enc.ids(units) for units in docs]
    ends = np.cumsum([0, *map(len, got)])
    flat = np.concatenate(got).astype(np.int32) if got else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), [enc.decode(ids.tolist()) for ids in got]


def _parts(batch: pa.RecordBatch, chars: int = 4_000_000):
    """Slices of a batch that hold about so many characters each."""
    sizes = np.cumsum([len(t) if t else 0 for t in batch.column("t").to_pylist()]) // chars if batch.num_rows else []
    starts = [0, *(int(i) + 1 for i in np.flatnonzero(np.diff(sizes)))] if batch.num_rows else []
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """Per row of ``df``: doc_id, ids, and decoded, the text that the ids decode to."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    id_kind = dict(rows.dtypes)["doc_id"]
    kind = f"doc_id {id_kind}, ids array<int>, decoded string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in _parts(batch):
                ids, decoded = _lists(enc, encoded_texts(enc, part.column("t").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            units = encoded_texts(enc, batch.column("t").to_pylist())
            own = [[enc.kept[u] for u in us] for us in units]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("span"), pa.array(units, pa.list_(pa.string())),
                 pa.array(own, pa.list_(pa.binary()))], ["row", "doc_id", "span", "units", "own"])

    def meet(table: pa.Table) -> pa.Table:
        enc = encoder(path)
        table = table.sort_by("span")
        units = table.column("units").to_pylist()
        for us, own in zip(units, table.column("own").to_pylist()):
            enc.kept.update(zip(us, own))
        ids, decoded = _lists(enc, [joined_units(enc, units)])
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "ids": ids, "decoded": pa.array(decoded, pa.string())})

    short = rows.filter(F.length("t") <= span).mapInArrow(whole, kind)
    at = F.sequence(F.lit(0), F.floor((F.length("t") - 1) / span).cast("int"))
    long = rows.filter(F.length("t") > span).withColumn("row", F.monotonically_increasing_id())
    cuts = long.select("row", "doc_id", F.posexplode(F.transform(at, lambda i: F.substring("t", i * span + 1, F.lit(span)))).alias("span", "t"))
    # As many tasks as the session shuffles to, so that the spans of one long text go to many.
    dealt = cuts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row", "span")
    done = dealt.mapInArrow(spans, f"row long, doc_id {id_kind}, span int, units array<string>, own array<binary>")
    return short.unionByName(done.groupBy("row").applyInArrow(meet, kind))
