"""Chunking, indexes, retrieval order and context."""

import random

import pytest
from pyspark.sql import functions as F

from survanta.functions import text as T
from survanta.functions.chunking import pack, sections
from survanta.operators import retrieval as R
from survanta.sources import store


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, source string, title string, text string")


@pytest.fixture(scope="module")
def chunks(spark):
    return frame(spark, [(1, "a.md", "Метрики проекта", "auc and logloss metrics explain the score"),
                         (2, "a.md", "Data", "datasets with censored rows"),
                         (3, "b.md", "Models", "kaplan meier and cox models for censored time"),
                         (4, "b.md", "Other", "nothing to see")])


def test_sections_and_packing(spark):
    text = "intro\n\n# One\nbody  \r\n\n## Two\n" + "x" * 25 + "\n\nshort\n\ntiny"
    df = spark.createDataFrame([(text,), ("  \n ",)], "t string")
    got = df.select(sections(F.col("t"), F.lit("file.md"))).collect()
    assert [s["title"] for s in got[0][0]] == ["file.md", "One", "Two"]
    assert got[1][0] == []
    parts = spark.createDataFrame([("x" * 25 + "\n\nshort\n\ntiny\n \nlonger one",)], "t string").select(pack(F.col("t"), 12)).first()[0]
    assert parts == ["x" * 12, "x" * 12, "x", "short\n\ntiny", "longer one"]


def test_chunks_keep_all_text(spark):
    df = spark.createDataFrame([(1, "# T\n" + "\n\n".join("word%d" % i for i in range(300)))], "id long, text string")
    out = R.chunk(df, "id", "text", max_chars=100).toPandas()
    assert sum(t.count("word") for t in out["text"]) == 300 and (out["text"].str.len() <= 100).all()


def test_tokens(spark):
    df = spark.createDataFrame([("The Ёлка and a B2_x, x!",)], "t string")
    assert df.select(T.tokenize(F.col("t"))).first()[0] == ["ёлка", "b2_x"]
    assert df.select(T.with_bigrams(T.words(F.col("t")))).first()[0] == [
        "the", "ёлка", "and", "b2_x", "the ёлка", "ёлка and", "and b2_x"]


def test_latex(spark):
    df = spark.createDataFrame([("\\section{Идея} % hidden\n\\textbf{bold} \\cite[1]{x} text. Next",)], "t string")
    assert df.select(T.clean_latex(F.col("t"))).first()[0].split() == ["#", "Идея", "bold", "x", "text.", "Next"]


@pytest.mark.parametrize("tex, want", [
    ("a % gone {\nb", "a b"),
    ("\\subsection*{Plan}\n\\begin{itemize}\\item one\\end{itemize}", "# Plan one "),
    ("\\emph{very} \\url{x.org}. {Braced} \\alpha*[o]rest", "very x.org.\nBraced rest"),
    ("\\section{\\textbf{In}}", " In "),
    ("x\\textbf{y}z {q}w \\% cut", "xyz q w \\"), ("\\section{Open", " Open"), ("\\textit{} e", " e"), ("\\emph*{a}b", " a b"),
    ("", ""), (None, None)])
def test_latex_cases(spark, tex, want):
    assert spark.createDataFrame([(tex,)], "t string").select(T.clean_latex(F.col("t"))).first()[0] == want


def test_chunks_that_differ_late_stay_apart(spark):
    same = "word " * 100
    c = frame(spark, [(1, "a", "t", same + "one"), (2, "a", "t", same + "two"), (3, "a", "t", same + "one")])
    q = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2)], "query_id long, chunk_id long, pos long")
    assert sorted(r["chunk_id"] for r in R.merge([q], c).collect()) == [1, 2]
    none = spark.createDataFrame([], "no int, source string, title string")
    assert [r["chunk_id"] for r in R.foundation(c, none, ["two"], 5).collect()] == [2]


def test_keyword_score(spark, chunks):
    q = spark.createDataFrame([(1, "metrics score models"), (2, "xyz")], "query_id long, text string")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in R.query_keywords(chunks, q).collect()}
    assert set(got) == {(1, 1), (1, 3)}
    assert abs(got[(1, 1)] - (2 * 1.2 + 3 * 2 / 3)) < 1e-9
    assert abs(got[(1, 3)] - (1.4 + 1.0 + 1.5)) < 1e-9


def test_index_round_trip_and_alias(spark, chunks, tmp_path):
    idx = R.index(chunks)
    store.write_tables(idx, str(tmp_path))
    back = {n: store.read_table(spark, str(tmp_path), n) for n in idx}
    q = spark.createDataFrame([(1, "censored cox models")], "query_id long, text string")
    assert R.query_tfidf(back, q).orderBy("rank").first()["chunk_id"] == 3
    vec = R.embed(chunks, "text", lambda ts: [[t.count("c"), t.count("m"), 1] for t in ts])
    assert R.index(vec, "semantic")["manifest"].first()["retriever"] == "embeddings"
    with pytest.raises(ValueError):
        R.index(chunks, "other")


def test_foundation_overview_and_merge(spark, chunks):
    req = spark.createDataFrame([(0, "b.md", "models"), (1, "a.md", "МЕТРИКИ"), (2, "a.md", "absent")], "no int, source string, title string")
    f = [r["chunk_id"] for r in R.foundation(chunks, req, ["censored", "see"], 4).orderBy("pos").collect()]
    assert f == [3, 1, 2, 4]
    assert [r["chunk_id"] for r in R.overview(chunks, req.select("no", "source").where("no < 2")).orderBy("pos").collect()] == [3, 1]
    q = spark.createDataFrame([(1, "cox models")], "query_id long, text string")
    h = R.hybrid(chunks, R.index(chunks), q, req, ["censored"], req.select("no", "source"), 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in h] == [3, 1, 2]


def test_same_requirement_takes_the_next_chunk(spark):
    c = frame(spark, [(1, "a", "T one", "x"), (2, "a", "T two", "y")])
    req = spark.createDataFrame([(0, "a", "t"), (1, "a", "t")], "no int, source string, title string")
    assert [r["chunk_id"] for r in R.foundation(c, req, ["zzz"], 10).orderBy("pos").collect()] == [1, 2]


def test_context_and_history(spark, chunks):
    q = spark.createDataFrame([(1, "metrics"), (2, "none here")], "query_id long, text string")
    out = {r["query_id"]: r["context"] for r in R.context(R.query_keywords(chunks, q), chunks, q).collect()}
    assert out[1].startswith("[1] Источник: a.md\nРаздел: Метрики") and out[2] == ""
    conv = spark.createDataFrame([(1, i, "system" if i == 9 else "user", " m%d " % i if i != 8 else "  ") for i in range(12)],
                                 "conv_id long, turn long, role string, text string")
    assert [r["text"] for r in R.history(conv).orderBy("turn").collect()] == ["m4", "m5", "m6", "m7", "m10", "m11"]


def dense(rng):
    """A few common words fill every text; many ties."""
    common, rare = [f"c{i}" for i in range(8)], [f"r{i}" for i in range(400)]
    texts = [" ".join([*(rng.choice(common) for _ in range(rng.randrange(1, 30))), *(rng.choice(rare) for _ in range(rng.randrange(3)))]) for _ in range(500)]
    texts[10:20] = [texts[9]] * 10
    return texts, [" ".join([*rng.sample(common, 3), *rng.sample(rare, 3)]) for _ in range(30)]


def graded(rng):
    """Words by falling frequency, questions that are pieces of texts."""
    texts = [" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(20, 60))) for _ in range(500)]
    return texts, [" ".join(rng.choice(texts).split()[5:17]) for _ in range(30)]


@pytest.mark.parametrize("make, share", [(dense, 1.0), (graded, 0.25)])
def test_bounds_skip_blocks_and_change_nothing(spark, monkeypatch, make, share):
    """Small blocks and parts: the same rows as the sum over all postings, from fewer pairs where words differ in frequency."""
    texts, asked = make(random.Random(4))
    c = frame(spark, [(i, "s", "t", t) for i, t in enumerate(texts)])
    q = spark.createDataFrame([*enumerate(asked), (90, "c1"), (91, texts[9]), (92, "nothing known"), (93, "")], "query_id long, text string")
    monkeypatch.setattr(R, "BLOCK", 4)
    monkeypatch.setattr(R, "PART", 100)
    idx = R.index(c)
    counts = R.term_counts(q, "query_id", R.with_bigrams(R.words(F.col("text"))))
    w = R._weights(counts, idx["idf"], "query_id").withColumnRenamed("w", "_q").persist()
    scores = idx["postings"].join(w, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("_q")).alias("score")).persist()
    for k in (1, 6, 1000):
        want = sorted(tuple(r) for r in R._ranked(scores, k).select("query_id", "chunk_id", "score", "rank").collect())
        got = sorted(tuple(r) for r in R.query_tfidf(idx, q, k).select("query_id", "chunk_id", "score", "rank").collect())
        assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
        assert all(abs(a[2] - b[2]) < 1e-8 for a, b in zip(got, want))
    assert R.tfidf_candidates(idx["blocks"], w, 6).count() < share * scores.count()
    assert idx["blocks"].agg(F.max(F.size("list"))).first()[0] == 4


def test_row_counts_equal_counts_by_shuffle(spark):
    c = frame(spark, [(1, "s", "t", "b a b"), (2, "s", "t", ""), (3, "s", "t", None), (4, "s", "t", "a a a a")])
    count = lambda f: sorted(tuple(r) for r in f(c, "chunk_id", R.words(F.col("text"))).collect())
    assert count(R.row_term_counts) == count(R.term_counts)


def test_a_filter_on_terms_reaches_the_postings(spark):
    """The blocks' window and grouping lie above the semi-join of the terms."""
    blocks = R.index(frame(spark, [(1, "s", "t", "a b c")]))["blocks"]
    plan = blocks.join(spark.createDataFrame([("a",)], "term string"), "term", "left_semi")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("LeftSemi")


def test_questions_sort_only_the_postings_of_their_terms(spark, monkeypatch):
    """The blocks a search opens are built from its terms' postings alone, and equal the whole index's blocks of those terms."""
    texts = ["aa bb cc dd", "aa bb ee", "ff gg hh", "aa ff"]
    c = frame(spark, [(i, "s", "t", t) for i, t in enumerate(texts)])
    q = spark.createDataFrame([(1, "aa bb"), (2, "ff")], "query_id long, text string")
    idx = R.index(c)
    sorted_rows, build = [], R._blocks
    monkeypatch.setattr(R, "_blocks", lambda postings: sorted_rows.append(postings.count()) or build(postings))
    got = R.query_tfidf(idx, q, 6).select("query_id", "chunk_id", "rank").collect()
    asked = idx["postings"].where(F.col("term").isin("aa", "bb", "aa bb", "ff"))
    assert sorted_rows == [asked.count()] and asked.count() < idx["postings"].count()
    assert sorted([(r[0], r[1]) for r in got]) == [(1, 0), (1, 1), (1, 3), (2, 2), (2, 3)]
    rows = lambda df: sorted((r["term"], r["part"], r["block"], r["top"], sorted(map(tuple, r["list"]))) for r in df.collect())
    assert rows(build(asked)) == rows(idx["blocks"].where(F.col("term").isin("aa", "bb", "aa bb", "ff")))


def test_norms_from_packed_postings(spark, monkeypatch):
    """Chunks' norms over all terms, however the postings are cut into packs and buckets, and the packing of numbers."""
    texts = ["aa bb cc dd aa", "aa bb ee", "", None, "ff gg hh", "aa ff"]
    c = frame(spark, [(i, "s", "t", t) for i, t in enumerate(texts)])
    counts = R.term_counts(c, "chunk_id", R.with_bigrams(R.words(F.col("text"))))
    raw = counts.join(R._idf(counts, c), "term").groupBy("chunk_id").agg(F.sqrt(F.sum(((1 + F.ln("n")) * F.col("idf")) ** 2)).alias("w"))
    want = sorted((r[0], round(r[1], 12)) for r in raw.collect())
    for terms, chars in ((1 << 22, 1 << 23), (1, 1)):
        monkeypatch.setattr(R, "PACK_TERMS", terms)
        monkeypatch.setattr(R, "BUCKET_CHARS", chars)
        assert sorted((r[0], round(r[1], 12)) for r in R._norms(c).collect()) == want
    for values in ([0], [1, 255, 256, 0], [2 ** 64 - 1, 5]):
        assert R._opened(R._shut(R.np.array(values, R.np.uint64))).tolist() == values


def test_a_search_shuffles_no_posting_of_other_terms(spark, monkeypatch):
    """Only the questions' terms are counted by themselves; the other terms of a chunk go into its norm."""
    c = frame(spark, [(i, "s", "t", t) for i, t in enumerate(["aa bb cc dd", "aa bb ee", "ff gg hh"])])
    q = spark.createDataFrame([(1, "aa")], "query_id long, text string")
    idx, rows, count = R.index(c), [], R.row_term_counts
    monkeypatch.setattr(R, "row_term_counts", lambda *a, **k: rows.append(count(*a, **k)) or rows[-1])
    R.query_tfidf(idx, q, 6).collect()
    assert sorted((r["chunk_id"], r["term"]) for r in rows[-1].collect()) == [(0, "aa"), (1, "aa")]
