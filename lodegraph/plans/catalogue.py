"""Query catalogue: name -> Spark query, and name -> equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodegraph.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "bm25_topk"
#: Tables whose rows take long to work on.
TEXTS = ("documents", "pages", "embeddings")

Tables = Callable[[str], DataFrame]


def query(name: str, sql: str | None = None, ints: tuple[str, ...] = ()):
    """Registers a function of (read) -> DataFrame, where read(table) reads a table of the query's folder.

    ``ints``: columns that are 32-bit integers here, as ranks and sizes are, and 64-bit ones in DuckDB.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        def tables(spark: SparkSession, sf_dir: str) -> Tables:
            found = lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")
            return lambda table: spread(found(table)) if table in TEXTS else found(table)

        QUERIES[name] = lambda spark, sf_dir: fn(tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(f'{c}::INTEGER AS {c}' for c in ints)}) FROM ({sql})" if ints else sql
        return fn

    return register


from lodegraph.plans import analytics_queries, governance_queries, graph_queries, knowledge_queries, lookup_queries, retrieval_queries, row_queries, shape_queries, stream_queries, text_queries  # noqa: E402, F401  they register themselves
