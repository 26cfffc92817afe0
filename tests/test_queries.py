"""Every registered query against its SQL, over whole tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries

from .compare import DATA, difference, duck

FOLDER = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    sql = oracle_sql().get(name)
    if sql is None:
        assert queries()[name](spark, FOLDER).count() > 0
    else:
        assert difference(spark, con, queries()[name], sql, FOLDER) is None


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
