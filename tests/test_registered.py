"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as contract
import oracle

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    _, _, problem = oracle.check(spark, con, FOLDER, name, QUERIES[name], SQL.get(name))
    assert problem is None, problem
