"""Every query against its SQL on the smallest tables, value for value."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, folder, con, name):
    assert compare(queries()[name](spark, folder), con, ORACLES[name]) is None


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 5 and all(0 <= r.contact_rate <= 1 for r in rows)
