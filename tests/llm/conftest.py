import pytest


@pytest.fixture
def frame(spark):
    """Rows of (doc_id, text) with columns whose names clash with those the operators make."""
    def make(rows, parts=3):
        schema = "doc_id long, text string, lang string, source string, n_chars long, length string, kept string, lo string, hi string, part string, score string, n string"
        full = [(i, t, None, "s", None if t is None else len(t), *["x"] * 7) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(parts)

    return make


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
