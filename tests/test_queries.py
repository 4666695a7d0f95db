"""Every registered query of the engine against its SQL, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from conftest import DATA
from diffloom import queries as engine
from duck import connect, same


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query_equals_sql(spark, con, name):
    same(engine.QUERIES[name](spark, DATA), con, engine.ORACLE_SQL[name])
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_contract():
    assert set(engine.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
