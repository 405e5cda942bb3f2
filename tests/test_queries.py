"""Every registered query runs on the small tables; those with SQL give the same rows."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests import oracle

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF_DIR)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, db, name):
    columns, rows = oracle.spark_rows(queries()[name](spark, SF_DIR))
    assert rows
    if name in oracle_sql():
        expected_columns, expected = oracle.sql_rows(db, oracle_sql()[name])
        assert columns == expected_columns
        assert rows == expected
