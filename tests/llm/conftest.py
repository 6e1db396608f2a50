import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Make a DataFrame of rows, cut into a few partitions, with extra columns whose names clash with inner ones."""

    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, slice int, words string"


@pytest.fixture(scope="session")
def docs(frame):
    """Documents from (doc_id, text) pairs, with clashing extra columns."""
    return lambda pairs: frame([(i, t, "en", None, None, "k", 1, "w") for i, t in pairs], DOCS)
