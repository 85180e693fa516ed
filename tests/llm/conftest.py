import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from a list of texts (ids from 0), or of (id, text) pairs."""

    def make(rows, extra=""):
        rows = [(i, r) if not isinstance(r, tuple) else r for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, f"doc_id bigint, text string{extra}")

    return make
