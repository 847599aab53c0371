"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import threading

import duckdb
import pytest

import __spark_entry__ as driver_contract
from banlist.plans import registry
from tests.check_oracles import duck, duck_rows, spark_rows
from tests.conftest import SF_SMALL

QUERIES = dict(registry.QUERIES)
ORACLES = dict(registry.ORACLES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_entry(spark):
    df = driver_contract.entry(spark)
    assert df.count() == 1 and "accuracy_with_taboo" in df.columns


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(driver_contract.queries())


def test_every_sql_ends_under_an_outer_limit():
    """Run as a subquery with a limit, too, and within a time limit."""
    connection = duck(SF_SMALL)
    slow = []
    for name, sql in ORACLES.items():
        timer = threading.Timer(30, connection.interrupt)
        timer.start()
        try:
            connection.execute(f"select * from ({sql}) q limit 5").fetchall()
        except duckdb.InterruptException:
            slow.append(name)
        finally:
            timer.cancel()
    assert not slow


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF_SMALL))
    expected_columns, expected = duck_rows(con, ORACLES[name])
    assert columns == expected_columns
    assert len(rows) == len(expected)
    assert rows == expected
