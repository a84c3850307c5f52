"""Byte-level BPE: every join against the library, on strings made to break at each possible place."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from survanta.llm import bytebpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bytebpe.Codec(PATH, public_tokenizers.PATTERN)


def folded(own, parts):
    return bytebpe.tree([own.split(p) for p in parts], own.pieces_joined, [])


@given(st.lists(st.text(alphabet="ab'srelvmdt 1\n\t .!é日 ́ ", max_size=7), max_size=12), st.randoms())
@settings(max_examples=600, deadline=None)
def test_any_cut_and_any_tree_give_the_librarys_ids(own, library, parts, rng):
    text = "".join(parts)
    want = library.encode_ordinary(text)
    assert own.encode([folded(own, [p for p in parts if p])])[0] == want
    # The join does not depend on the tree: fold in a random order.
    left = [own.split(p) for p in parts]
    while len(left) > 1:
        i = rng.randrange(len(left) - 1)
        left[i:i + 2] = [own.pieces_joined(left[i], left[i + 1])]
    assert own.encode(left or [[]])[0] == want
    assert own.decode(want) == text.encode()


@pytest.mark.parametrize("text", ["A" * 30_001, "ab" * 9_999 + "c", "日本語" * 4_000, "é" * 5_000, " " * 4_000 + "x", "!?" * 3_000, "1234567890" * 900,
                                  "\n" * 3_000, "the" * 6_000])
def test_long_matches(own, library, text):
    assert own.encode([own.pieces(text)])[0] == library.encode_ordinary(text)


def test_tokens_join_at_any_place(own):
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("aeinrst日é") for _ in range(rng.randrange(2, 60)))
        cuts = sorted({0, len(text), *(rng.randrange(len(text)) for _ in range(3))})
        leaves = [own.whole.encode_ordinary(text[a:b]) for a, b in zip(cuts, cuts[1:])]
        assert bytebpe.tree(leaves, own.tokens_joined, []) == own.whole.encode_ordinary(text)


def test_every_token_is_its_own_encoding(own):
    """The pair rule needs it."""
    for i, raw in own.bytes_of.items():
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        assert own.whole.encode_ordinary(text) == [i]


def test_every_character_is_split_as_in_the_library(own, library):
    """Class by class over all of Unicode, between letters, digits and spaces."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 20_000):
        text = "".join("a" + c + "1" + c + " " + c + ". " for c in chars[at:at + 20_000])
        pieces = own.split(text)
        assert "".join(pieces) == text
    for c, e in own.split.theirs.items():
        for at in range(0, len(chars), 20_000):
            part = chars[at:at + 20_000]
            plain = "".join(part).translate(own.split.fix)
            want = set(bytes(e.encode_ordinary("".join(part))).decode())
            assert {x for x, y in zip(part, plain) if own.split.ours[c].match(y)} == want
    assert library.encode_ordinary("".join(chars)) == own.encode([own.pieces("".join(chars))])[0]


def test_table(spark, odd, library):
    got = {(r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in bytebpe.encode(odd, PATH, public_tokenizers.PATTERN, span=1000).collect()}
    want = {(r["doc_id"], tuple(library.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in odd.collect()}
    assert got == want
    assert bytebpe.encode(odd, PATH, public_tokenizers.PATTERN, span=1000).count() == odd.count()
    assert bytebpe.encode(odd.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_byte_bpe"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
