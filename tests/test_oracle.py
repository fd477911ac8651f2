"""Every query that has SQL, against DuckDB on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from lodegraph.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def shown(value):
    if value is None or value != value:
        return ""
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(list(value)) if isinstance(value, (list, tuple)) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    found = catalogue.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    at = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    assert sorted(found.columns) == sorted(want.columns)
    rows = sorted(tuple(shown(r[c]) for c in sorted(found.columns)) for r in found.collect())
    assert rows == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    catalogue.QUERIES[name](spark, FOLDER).collect()
