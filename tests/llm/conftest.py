import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY = [(1, None, None, None, None), (2, "", "en", None, 0), (3, " \t\n ", "en", "a", 4), (4, "\U0001f600 ¿?", None, "b", 4)]


@pytest.fixture
def documents(spark):
    def make(texts, source="s", lang="en", more=()):
        rows = [(10 + i, t, lang, source, len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame([*EMPTY, *rows, *more], DOCS)

    return make


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
