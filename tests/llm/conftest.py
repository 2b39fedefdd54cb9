import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A small table of awkward rows: nulls, empty texts, ties, repeats, clashing names."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.selectExpr("*", "'x' AS words", "1 AS key", "2 AS n", "3 AS row", "'y' AS kept") if extra else df

    return make
