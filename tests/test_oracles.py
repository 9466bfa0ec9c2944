"""Every registered query against its SQL text."""

import pytest
from oracle import compare, connect

from depotlens.plans import ORACLES, QUERIES

PAIRS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf, name):
    assert name in ORACLES
    columns, names, types, kinds, mine, theirs = compare(spark, con, QUERIES[name], ORACLES[name], sf)
    assert columns == names
    assert {c: PAIRS[t] for c, t in types.items()} == kinds
    assert mine == theirs


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
