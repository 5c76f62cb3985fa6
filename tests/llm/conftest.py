import pytest


@pytest.fixture
def df(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make
