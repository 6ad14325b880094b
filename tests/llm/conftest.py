import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts, first=0, schema=DOCUMENT):
        rows = [(first + i, t, "en", "s", len(t) if t else None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, schema)

    return make
