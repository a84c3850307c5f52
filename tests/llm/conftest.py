import pytest

ODD_TEXTS = [None, "", " \n\t", "one", "A" * 30_000, "Repeat this line of words please now.\n" * 40, "Repeat this line of words please now.\n" * 40,
             "é ñ ß 日本語 <|endoftext|> x", "plain words " * 3000]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, very long and repeated texts, a repeated row, and columns whose names clash with results."""
    rows = [(i, t, "x", True, 1.0, 7) for i, t in enumerate(ODD_TEXTS)] + [(5, ODD_TEXTS[5], "x", True, 1.0, 7), (None, "a row without an id", "x", True, 1.0, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, name string, kept boolean, score double, n_words int")
