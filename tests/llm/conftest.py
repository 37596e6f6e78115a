import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with a column whose name clashes with internal ones."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], DOCS)
    return make
