"""Small frames with what real tables hold: nulls, empty and long texts, ties, clashing names."""

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from texts, or from (id, text) pairs, with extra columns of awkward names."""
    from panelcast.llm import _base

    _base.ship(spark)

    def make(texts):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
        for name in ("id", "h", "key", "w", "at", "block", "n_words", "findings", "ids", "k_id", "_hit_id", "base"):
            df = df.selectExpr("*", f"7 as `{name}`")
        return df

    return make
