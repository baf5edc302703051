import pytest

pytest.importorskip("reviewlake.llm.common")

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    def make(rows, extra=""):
        return spark.createDataFrame(rows, DOCS + extra)

    return make
