import sys

import pytest

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")


@pytest.fixture(scope="session")
def spark():
    from check import session
    return session()


@pytest.fixture
def rows(spark):
    """rows('a int, b string', (1, 'x'), ...) -> DataFrame"""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)
