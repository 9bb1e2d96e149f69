import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, `_text` string, key int"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of these (id, text) pairs, with columns whose names clash with those of operators."""

    def make(rows, langs=None):
        langs = langs or ["en"] * len(rows)
        full = [(i, t, g, None, len(t or ""), "x", "y", 7) for (i, t), g in zip(rows, langs)]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")

    return make
