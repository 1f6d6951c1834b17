import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from texts (ids from 0) or from (id, text) pairs."""

    def make(texts):
        pairs = [x if isinstance(x, tuple) else (k, x) for k, x in enumerate(texts)]
        rows = [(i, t, "en", "s", len(t or "")) for i, t in pairs]
        return spark.createDataFrame(rows, DOC_SCHEMA)

    return make
