"""Every query with SQL must give the rows DuckDB gives."""

import pytest

from compare import compare, connect
from metricloom.plans.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    ok, message = compare(spark, duck, name, QUERIES[name], ORACLES[name], SF_DIR)
    assert ok, message


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
