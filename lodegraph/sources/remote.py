"""Paged remote sources: one task per account, pages until there are none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.streaming.machines import with_backoff

#: (account, cursor or None) -> (rows as dicts, next cursor or None).
Fetch = Callable[[str, str | None], tuple[list[dict], str | None]]


def paged(accounts: DataFrame, fetch: Fetch, schema: str, account: str = "account", tries: int = 3, wait: Callable[[float], None] | None = None) -> DataFrame:
    """All rows of every account, fetched on the executors page by page; a failing page is tried again."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extra = {} if wait is None else {"wait": wait}
        for batch in batches:
            for name in batch[account]:
                cursor = None
                while True:
                    rows, cursor = with_backoff(lambda name=name, cursor=cursor: fetch(name, cursor), tries, **extra)
                    yield pd.DataFrame([{"account": name, **r} for r in rows], columns=["account", *names])
                    if cursor is None:
                        break

    return accounts.select(account).distinct().repartition(account).mapInPandas(run, f"account string, {schema}")


def meetings(pages: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Meetings not yet here, each once."""
    return pages.dropDuplicates([key]).join(known.select(key).distinct(), key, "left_anti")


def account_summary(meetings_: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Totals, pending and the share already done by account."""
    joined = meetings_.join(done.select(key, F.lit(1).alias("d")).distinct(), key, "left")
    return joined.groupBy("account").agg(F.count("*").alias("total"), F.count_if(F.col("d").isNull()).alias("pending"), F.round(F.avg(F.coalesce("d", F.lit(0))), 4).alias("skip_rate"))
