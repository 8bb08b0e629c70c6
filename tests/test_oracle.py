"""Every registered question that SQL can express, against DuckDB on the small tables."""

import pytest

import __spark_entry__ as entry
from tillroll.checks import compare
from conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return compare.open_tables(SMALL)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equal(spark, con, name):
    verdict, rows, _ = compare.compare(spark, con, SMALL, name)
    assert verdict.startswith("equal"), verdict


def test_every_twin_has_a_question():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "customer_id" and df.count() > 50
