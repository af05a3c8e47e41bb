import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """A function from (doc_id, text[, lang, source]) rows to a table like documents."""

    def make(rows):
        full = [(*r, *("en", "s")[len(r) - 2 :], len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def clash(docs):
    """Adds columns with names that operators use themselves."""
    names = ["n", "id", "h", "v", "size", "comp", "kept", "token", "pos", "_id", "_h", "_row", "n_words", "x1", "g", "bucket", "start", "component_id", "drop", "score", "_k"]

    def add(df):
        from pyspark.sql import functions as F

        return df.withColumns({n: F.lit("other") for n in names})

    return add
