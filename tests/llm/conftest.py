import pytest

from . import fixture_docs


@pytest.fixture(scope="session")
def rows():
    return fixture_docs.make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, fixture_docs.SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], fixture_docs.SCHEMA)


@pytest.fixture(scope="session")
def unknown(spark):
    """Rows that are null in every column."""
    return spark.createDataFrame([(None,) * 12] * 3, fixture_docs.SCHEMA)
