import pytest


@pytest.fixture
def docs_of(spark):
    """Documents with the columns of the real table; missing values are null."""

    def build(rows):
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return build
