import pytest
from pyspark.sql import functions as F
from samples import SCHEMA, rows

@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 > 0), int(i % 2), "extra") for i in range(1, 25)] + [(1, 0, 1, None), (None, 1, 1, None), (7, None, None, None)], "doc_id long, quality int, toxic int, text string")


@pytest.fixture
def get():
    """Rows of a DataFrame as dictionaries, sorted by their text form."""
    return lambda df: sorted((r.asDict() for r in df.select(*[F.col(f"`{c}`") for c in df.columns]).collect()), key=repr)
