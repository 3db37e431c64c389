import pytest

CLAUSE = "clause_uid long, norm_key string, norm_id string, language string, clause_number string, text string"
SECTION = "section_uid long, doc_id string, raw_text string, extraction_confidence double"
DOCUMENT = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def clauses(spark):
    return lambda rows: spark.createDataFrame([(u, "N:1:EN", "N", lang, "4", t) for u, lang, t in rows], CLAUSE)


@pytest.fixture(scope="session")
def sections(spark):
    return lambda rows: spark.createDataFrame([(u, "D", t, 1.0) for u, t in rows], SECTION)


@pytest.fixture(scope="session")
def documents(spark):
    return lambda rows: spark.createDataFrame([(u, t, "en", s) for u, t, s in rows], DOCUMENT)
