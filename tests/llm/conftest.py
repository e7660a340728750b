import pytest


@pytest.fixture
def table(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with the columns of the real table and clashing extras."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1] or ""), "x", 7, "y") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, _id string, shard int, key string")

    return make
