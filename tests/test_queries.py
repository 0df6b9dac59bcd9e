"""Every query with SQL equals it on the smallest table."""

import pytest
from oracle import duck, same

from tessera.plans import oracles, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query(spark, con, name):
    assert same(registry.QUERIES[name](spark, SF), con.sql(oracles.SQL[name])) == ""
