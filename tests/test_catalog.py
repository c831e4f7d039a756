"""Every catalog query against its DuckDB twin on the smallest tables; those without a twin must give rows."""

import os

import pytest

from driftwood.plans import catalog
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.ENTRIES))
def test_query(spark, con, name):
    sql = catalog.oracle_sql().get(name)
    query = catalog.queries()[name]
    if sql:
        assert difference(spark, con, SF, query, sql) is None
    elif name != "dfa_cubic":
        assert query(spark, SF).limit(1).count() == 1


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0
