"""Every registered query against its SQL counterpart on the same files."""

import pytest

import __spark_entry__ as contract
from checks.compare import connect, differences
from checks.oracle import ORACLE_SQL
from rainledger.plans.catalogue import registered

QUERIES = registered()
SQL = ORACLE_SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf_dir, duck, name):
    assert differences(duck, QUERIES[name](spark, sf_dir), SQL[name]) is None


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 10
    assert [r["total_sales"] for r in rows] == sorted((r["total_sales"] for r in rows), reverse=True)
