"""Each query equals its SQL twin on the smallest data."""
import pytest
from check import compare, connect

from corrobora.plans.catalog import load_all

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(load_all()))
def test_query(spark, con, name):
    n, err = compare(spark, con, load_all()[name], SF)
    assert not err, err
