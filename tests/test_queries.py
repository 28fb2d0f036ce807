"""Every registered query against its SQL, value by value."""

import os
import time
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _rows(rows, order):
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def _order(columns):
    return sorted(range(len(columns)), key=columns.__getitem__)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    started = time.time()
    result = QUERIES[name](spark, SF_DIR)
    found = result.collect()
    print(f"{name}: {time.time() - started:.2f}s")
    expected = duck.sql(ORACLES[name])
    assert sorted(result.columns) == sorted(expected.columns)
    types = {c: str(t) for c, t in zip(expected.columns, expected.types)}
    names = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
             "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    assert {c: names.get(t, t) for c, t in result.dtypes} == types
    ours = _rows(found, _order(result.columns))
    theirs = _rows(expected.fetchall(), _order(expected.columns))
    assert len(ours) == len(theirs)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
