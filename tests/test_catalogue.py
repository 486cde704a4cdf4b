"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import pytest
from compare import connection, differences

from weftgraph.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
