import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, g int, n string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 7, "x", 1, "y") for i, t in rows], SCHEMA)

    return make


ODD = [(None, None), (None, "a b"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "Zero width   café \U0001f600 &amp;"), (6, "word " * 30_000)]


@pytest.fixture
def odd(docs_of):
    """Null ids and texts, blank, repeated and very long rows."""
    return docs_of(ODD)


@pytest.fixture
def none(docs_of):
    return docs_of([])
