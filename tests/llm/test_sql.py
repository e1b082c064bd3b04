"""Queries with SQL, on the smallest tables."""

import pytest

from checks.compare import connect, differences
from rainledger.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf_dir, name):
    assert differences(connect(sf_dir), QUERIES[name](spark, sf_dir), ORACLE_SQL[name]) is None
