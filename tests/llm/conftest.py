import pytest


def documents(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows: documents(spark, rows)
