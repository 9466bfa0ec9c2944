"""Registered SQL texts against the queries."""

import pytest
from oracle import compare, connect

from depotlens.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_equals_query(spark, sf, name):
    cols, names, _, _, mine, theirs = compare(spark, connect(sf), QUERIES[name], ORACLES[name], sf)
    assert cols == names and mine == theirs
