import pytest

import oracle
from lectern import registered as own


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_matches_sql(spark, sf, con, name):
    oracle.compare(spark, con, sf, own.QUERIES[name], own.SQL[name])


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.SQL)))
def test_query_runs(spark, sf, name):
    assert own.QUERIES[name](spark, sf).count() > 0
