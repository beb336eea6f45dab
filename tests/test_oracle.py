"""Every query with check SQL gives DuckDB's rows on whole tables."""

import pytest
from compare import differences, duck
from conftest import SMALL

import __spark_entry__ as contract

ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, connection, name):
    assert differences(contract.queries()[name](spark, SMALL), connection, ORACLES[name]) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries())


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1
