"""Every registered traffic query against its SQL, on the smallest tables."""

import pytest

from comparison import connection, same
from fairlead.plans.catalog import QUERIES
from fairlead.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    same(QUERIES[name](spark, sf_dir), con, ORACLES[name])
