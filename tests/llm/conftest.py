import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, None, "en", "a", None, "x", 1),
        (2, "", None, "a", 0, "x", 1),
        (3, " \n\t\n", "en", None, 4, "x", 1),
        (4, "one word", "en", "a", 8, "x", 1),
        (4, "one word", "en", "a", 8, "x", 1),
        (None, "a row without an id", "en", "a", 19, "x", 1),
        (5, "é ñ ß İ 中文 ́ ﬁ 🙂 <|endoftext|> it's", "en", "a", 9, "x", 1),
        (6, "long word " * 30_000, "en", "a", 300_000, "x", 1),
        (7, "x" * 50_000, "en", "a", 50_000, "x", 1),
        (8, "one word", "en", "a", 8, "x", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, size int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
