import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents of (doc_id, text) pairs, with an extra column whose name clashes with inner ones."""

    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema).selectExpr("*", "1 as node", "'x' as k1", "2 as score", "3 as block")

    return make
