import pytest


@pytest.fixture
def make(spark):
    """make(rows, schema): a DataFrame of literal rows."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
