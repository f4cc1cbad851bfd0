import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table of texts: ids from 0, or (id, text) pairs."""

    def make(*texts, extra=""):
        pairs = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        rows = [(i, t, "en", "src", len(t or "")) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make
