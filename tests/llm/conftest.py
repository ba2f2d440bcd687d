import pytest

from pageproof.llm.common import prepared


@pytest.fixture(scope="session")
def llm(spark):
    """The session, ready for the operators' functions in Python."""
    return prepared(spark)


@pytest.fixture
def docs(llm):
    """Documents from a list of texts or (doc_id, text), with columns whose names
    clash with those of results."""

    def build(rows, lang=None):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, lang, "s", None, 7, "x") for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string"
        return llm.createDataFrame(full, schema)

    return build
