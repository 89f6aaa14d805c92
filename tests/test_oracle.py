"""Every registered query against DuckDB on the same tables."""

import os

import pytest
from oracle_check import connect, difference

import __spark_entry__ as contract
from logloom.plans import catalog, oracle

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not found")


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert catalog.queries().keys() == oracle.oracle_sql().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, tables, name):
    frame = contract.queries()[name](spark, SF_DIR)
    assert difference(frame, tables, contract.oracle_sql()[name]) is None
