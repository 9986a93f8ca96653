"""Every registered query on the small tables: equal to its oracle, or at least runnable."""

import pytest
from check_oracle import compare, duck

from riskloom.plans import registry
from riskloom.session import scratch

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_oracle(spark, con, name):
    with scratch(spark):
        got = registry.QUERIES[name](spark, SF).toArrow()
    assert compare(got, con.execute(registry.ORACLES[name]).to_arrow_table()) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    with scratch(spark):
        assert registry.QUERIES[name](spark, SF).toArrow().num_columns > 0
