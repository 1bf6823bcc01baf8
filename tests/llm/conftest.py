import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    return SF


@pytest.fixture()
def documents(spark):
    """(doc_id, text) rows as a table with the columns of documents and one more."""

    def make(rows, source="s"):
        rows = [(i, t, "en", source, None if t is None else len(t), "x") for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `key` string")

    return make


@pytest.fixture()
def odd(documents):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = "lorem ipsum dolor sit amet " * 4000
    return documents([(None, "no id here"), (1, None), (2, ""), (3, long), (3, long), (3, "another text of the same id"), (4, " \n\t"), (5, "é🎉 ǅ ́"), (2, "")])
