"""Periodic runs: the grammar's answers and the whole operator against brute force."""

import random

import numpy as np
from hypothesis import given, settings, strategies as st

from survanta.llm import runs


def by_hand(w, least=runs.LEAST):
    """Each period's unbroken stretches of equal words a period apart; of equal ends the smallest period."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and j > i:
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def periodic(rng, n, k):
    d = [rng.randrange(k) for _ in range(n)]
    if n > 20:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(2, 9)
        d = [d[i] if i < a else d[a + (i - a) % p] for i in range(n)]
    return d


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        docs = [periodic(rng, rng.choice([0, 1, 5, 12, 30, 80, 150]), rng.choice([1, 2, 2, 3, 5, 50])) for _ in range(rng.randrange(1, 8))]
        least = rng.choice([2, 12, 12, 20])
        got = runs.runs_of([np.array(d, np.int64) for d in docs], least)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [by_hand(d, least) for d in docs]


@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4), st.data())
@settings(max_examples=300, deadline=None)
def test_extensions_equal_a_plain_scan(docs, data):
    flat, marks = [], []
    for k, d in enumerate(docs):
        marks.append(len(flat))
        flat += [3 + k, *d]
    marks.append(len(flat))
    flat.append(3 + len(docs))
    g = runs.Grammar(np.array(flat, np.int64), np.array(marks))
    pairs = [(u, v) for u in range(len(flat)) for v in range(u + 1, len(flat))]
    if not pairs:
        return
    u, v = np.array(pairs).T
    for back in (False, True):
        got = g.extension(u, v, back)
        for (x, y), n in zip(pairs, got.tolist()):
            want = 0
            while 0 <= x and y < len(flat) and flat[x] == flat[y]:
                want, x, y = want + 1, x + (-1 if back else 1), y + (-1 if back else 1)
            assert n == want


def test_grammar_is_small_on_repetitions():
    """A block is one symbol, so a text of one word needs a handful of levels, and any text shrinks by rounds."""
    one = runs.Grammar(np.array([1, *[0] * 50_000, 2]), np.array([0, 50_001]))
    assert len(one.sym) < 50_002 + 10
    rng = np.random.default_rng(2)
    any_text = runs.Grammar(np.concatenate([[1000], rng.integers(0, 1000, 50_000), [1001]]), np.array([0, 50_001]))
    assert len(any_text.sym) < 6 * 50_000


def test_long_repetitions():
    got = runs.runs_of([np.zeros(20_000, np.int64), np.tile(np.arange(7), 3_000), np.arange(9_000), np.tile(np.arange(5_000), 3)])
    assert [g.tolist() for g in got] == [[[0, 20_000, 1]], [[0, 21_000, 7]], [], [[0, 15_000, 5_000]]]


def test_table(spark, odd):
    got = {(r["doc_id"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in runs.runs(odd).collect()}
    want = set()
    for r in odd.collect():
        w = (r["text"] or "").split()
        found = by_hand(w[:2000]) if len(w) > 2000 else by_hand(w)
        if len(w) > 2000:  # one stretch of two words over the whole text
            assert found == [(0, 2000, 2)]
            found = [(0, len(w), 2)]
        drop = {i for s, n, q in found for i in range(s + q, s + n)}
        want.add((r["doc_id"], tuple(found), " ".join(x for i, x in enumerate(w) if i not in drop)))
    assert got == want
    assert runs.runs(odd).count() == odd.count()
    assert runs.runs(odd.limit(0)).count() == 0


def test_ties_and_case(spark):
    rows = spark.createDataFrame([(1, "a b " * 8 + "x y z " + "c d " * 8), (2, "A a " * 6), (3, "q q " * 12)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in runs.runs(rows).collect()}
    assert got == {1: [(0, 16, 2), (19, 16, 2)], 2: [(0, 12, 2)], 3: [(0, 12, 1)]}
