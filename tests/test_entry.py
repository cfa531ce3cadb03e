"""Every query of the catalog against its DuckDB equivalent, on a driver table where there is one."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from gaugework import catalog

DIR = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def test_registry():
    assert set(catalog.QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    if not os.path.isdir(DIR):
        pytest.skip("no test data")
    assert entry_module.entry(spark).first()[0].startswith("{user_")


@pytest.mark.parametrize("name", catalog.ORACLE_SQL)
def test_oracle(spark, name):
    if not os.path.isdir(DIR):
        pytest.skip("no test data")
    con = duckdb.connect()
    for table in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DIR}/{table}.parquet')")
    found = catalog.QUERIES[name](spark, DIR)
    expected = con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert [TYPES[found.schema[c].dataType.simpleString()] for c in columns] == [str(dict(zip(expected.columns, expected.types, strict=True))[c]) for c in columns]
    rows = [tuple(r[c] for c in columns) for r in found.collect()]
    at = [expected.columns.index(c) for c in columns]
    assert sorted(rows, key=repr) == sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=repr)
