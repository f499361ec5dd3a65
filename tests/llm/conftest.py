import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame of documents from (doc_id, text) or (doc_id, text, lang) rows, with extra columns whose names clash with the operators' own."""
    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or ""), *((7, "x", 1) if extra else ())) for r in rows]
        return spark.createDataFrame(full, DOCS + (", h long, gone string, rate int" if extra else ""))
    return make


@pytest.fixture
def folder(spark):
    from gridpulse.llm.common import run_folder
    return run_folder(spark, "test")
