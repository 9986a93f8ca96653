"""Registered queries with SQL equal it on the small tables; all of them return a row per document."""

import pytest
from check_oracle import compare, duck

from riskloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF).toArrow()
    assert compare(got, con.execute(queries.ORACLES[name]).to_arrow_table()) == []
