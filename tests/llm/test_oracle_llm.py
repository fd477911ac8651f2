"""Queries of this subpackage that have SQL, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest
from lodegraph.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLE_SQL[name])
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_every_operator_has_a_query():
    import __spark_entry__

    names = set(queries.QUERIES)
    assert "pipeline" in __spark_entry__.queries() and set(__spark_entry__.queries()) > names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
