import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Builds a documents table from (doc_id, text) pairs, with extra columns whose
    names clash with result columns."""
    def build(rows, lang=None):
        full = [(i, t, lang[k] if lang else "en", "s", len(t or ""), "x", -1) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, n_words string, rank int"
        ).repartition(3)
    return build
