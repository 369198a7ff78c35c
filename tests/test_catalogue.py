"""Every query of the engine runs, and gives what its SQL gives in another engine."""

from __future__ import annotations

import pytest

from same import assert_same, connect
from tallyworks.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    assert_same(QUERIES[name](spark, sf_dir), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    assert len(set(frame.columns)) == len(frame.columns)
    frame.collect()


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
