import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, key string"


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names."""
    long = "\n".join(f"a rather long line number {i} of the very long text" for i in range(3000))
    rows = [
        (1, None, None, None, None, None, None),
        (2, "", "en", "s", 0, "x", "y"),
        (3, long, "en", "s", len(long), None, None),
        (3, long, "en", "s", len(long), None, None),
        (None, "text without an id that is long enough to be kept as one line", "en", None, None, None, None),
        (5, " \t \n\n ", "en", "s", 6, None, None),
        (6, "hé 你好 \U0001f600 <|endoftext|>   x\x00y", "en", "s", 9, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
