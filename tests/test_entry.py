import pytest

import __spark_entry__ as entry
from verification import catalogue, compare, oracle


@pytest.fixture(scope="module")
def connection(sf_dir):
    return compare.oracle_connection(sf_dir)


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(oracle.oracle_sql())
    assert set(catalogue.queries()) <= set(entry.queries()) and set(oracle.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_equals_its_sql(spark, sf_dir, connection, name):
    result = entry.queries()[name](spark, sf_dir)
    assert compare.difference(result, connection.sql(entry.oracle_sql()[name])) is None
