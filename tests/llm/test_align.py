"""Token alignment against a plain one that encodes each whole text with the two libraries and links token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from survanta.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def own():
    return align.pair(A, B)


def plain(libraries, own, text):
    """Groups of (ids of A, ids of B)."""
    tok, sp = libraries
    if not text:
        return []
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    raw = (" " + text).encode()
    if b"".join(own.a.raw[i] for i in a) != raw or b"".join(own.b.raw[i] for i in b) != raw:
        return []
    ends = [np.cumsum([len(s.raw[i]) for i in ids]).tolist() for s, ids in ((own.a, a), (own.b, b))]
    shared = sorted(set(ends[0]) & set(ends[1]))
    out, i, j = [], 0, 0
    for e in shared:
        p, q = ends[0].index(e) + 1, ends[1].index(e) + 1
        out.append((a[i:p], b[j:q]))
        i, j = p, q
    return out


def plain_rows(libraries, own, rows):
    """One tuple per (id, text): the operator's numbers and groups."""
    groups = [plain(libraries, own, t) for _, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    docs = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    return [(i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if docs[p] == most[p[0]]),
             sum(n * docs[p] for p, n in c.items()), ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)) for (i, _), g, c in zip(rows, groups, links)]


@given(st.text(alphabet="ab thé日▁\n\t \x1c᠎ 'sre.!1😀<>|", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_units_give_the_tokens_of_the_whole_text(libraries, own, text):
    tok, sp = libraries
    (a,), (b,) = own.encode([text])
    want = plain(libraries, own, text)
    assert np.frombuffer(a, own.a.kind).tolist() == [i for x, _ in want for i in x]
    assert np.frombuffer(b, own.b.kind).tolist() == [i for _, y in want for i in y]


def test_windows_end_at_shared_ends_and_spell_the_text(own):
    texts = ["the internationalisation of antidisestablishmentarianism", "", "naïve 日本語 text, 12345 and unbelievably so", "x" * 3_000]
    a, b = own.encode(texts)
    sizes, seq, known = align.windows(own, a, b)
    assert len(set(known)) == len(known) and sizes[1] == 0
    at = 0
    for t, n in zip(texts, sizes.tolist()):
        spelt = [b"".join(s.raw[i] for i in np.frombuffer(known[k][z], s.kind)) for z, s in enumerate((own.a, own.b)) for k in seq[at:at + n].tolist()]
        assert spelt[:n] == spelt[n:] and b"".join(spelt[:n]) == ((" " + t).encode() if t else b"")
        assert all(w.startswith(b" ") for w in spelt[:n])
        at += n


def test_large_groups_count_the_same(own, monkeypatch):
    a, b = own.encode(["supercalifragilistic " * 3 + "zzqxj" * 50])
    x, y = np.frombuffer(a[0], own.a.kind), np.frombuffer(b[0], own.b.kind)
    one = align.Aligned(own, np.array([len(x)]), x, np.array([len(y)]), y)
    monkeypatch.setattr(align, "LINKS", 2)
    other = align.Aligned(own, np.array([len(x)]), x, np.array([len(y)]), y)
    assert other.code.tolist() == one.code.tolist() and other.times.tolist() == one.times.tolist() and one.times.max() > 1


def test_table(spark, odd, libraries, own, monkeypatch):
    rng = random.Random(8)
    vocab = ["the", "Zürich", "tokenisation", "x1", "日本", "unbelievable", "\n", "don't", "ab"]
    more = spark.createDataFrame([(100 + i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(40)))) for i in range(60)] + [(200, "a▁b and c")], "doc_id long, text string")
    rows = odd.select("doc_id", "text").unionByName(more).repartition(5)
    got = sorted(map(tuple, align.align(rows, A, B).collect()), key=repr)
    assert got == sorted(plain_rows(libraries, own, [(r["doc_id"], r["text"]) for r in rows.collect()]), key=repr)
    assert next(r for r in got if r[0] == 200)[1:] == (0, 0, 0, 0, 0, 0, "")
    assert align.align(odd, A, B).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert align.align(odd.limit(0), A, B).count() == 0


def test_query(spark, sf_dir, libraries, own):
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_token_alignment"](spark, sf_dir).collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_rows(libraries, own, rows)
    assert len(got) == len(rows) == len(want)
    for i, *numbers, groups in want:
        assert list(got[i])[1:7] == numbers
        assert got[i]["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if numbers[0] else "")
