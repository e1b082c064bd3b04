import pytest

from edge_rows import EDGES, frame


@pytest.fixture(scope="session")
def edges(spark):
    return frame(spark, EDGES).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, EDGES).limit(0)
