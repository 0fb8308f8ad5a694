"""Every query with a SQL twin gives DuckDB's rows; the others give rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare
from tidyfold.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    result, _, _ = compare(spark, SMALL, name, queries()[name], oracle_sql()[name])
    assert result.startswith("match"), result


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert not queries()[name](spark, SMALL).isEmpty()


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
