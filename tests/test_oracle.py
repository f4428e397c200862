"""Every registered query that has a SQL twin against it."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as contract
from feedworks.catalogue.queries import all_queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query_equals_oracle(spark, db, name):
    df = contract.queries()[name](spark, SF_DIR)
    assert compare(df, db, contract.oracle_sql()[name]) is None


def test_every_query_has_an_oracle():
    """Queries on training text, where present, may go without."""
    assert set(all_queries()) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_returns_rows(spark):
    assert not contract.entry(spark).isEmpty()
