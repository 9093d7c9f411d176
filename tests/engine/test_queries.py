"""Every registered query against its SQL on the smallest tables."""

import os

import oracle
import pytest

from tracklane import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert oracle.compare(df, con, sql) == ""
