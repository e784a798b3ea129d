"""Every registered query against its SQL oracle on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registered
from conftest import SMALL


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(repr(row[i]) for i in order) for row in rows)


def test_every_query_has_an_oracle():
    assert set(registered.QUERIES) == set(registered.ORACLES)


@pytest.mark.parametrize("name", list(registered.QUERIES))
def test_query_equals_oracle(spark, oracle, name):
    frame = registered.queries()[name](spark, SMALL)
    found = normalized(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = oracle.execute(registered.oracle_sql()[name])
    expected = normalized([d[0] for d in cursor.description], cursor.fetchall())
    assert found == expected


def test_entry(spark):
    assert registered.entry(spark).count() == 10
