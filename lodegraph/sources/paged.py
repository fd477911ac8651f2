"""Paged remote sources as a data source of Spark, for tables and for streams that resume where they stopped."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lodegraph.streaming.machines import with_backoff

#: (account, page token or None for the first) -> (ids of the page, next token or None).
ListPage = Callable[[str, str | None], tuple[list[str], str | None]]
#: (account, id) -> the item's values by column.
Detail = Callable[[str, str], dict]


@dataclass
class Span(InputPartition):
    """Items ``first`` to ``last`` (exclusive) of one page of one account."""

    account: str
    token: str | None
    first: int
    last: int


@dataclass(frozen=True)
class Remote:
    """How a remote account is read: its accounts, columns, functions, and what is done with items that fail."""

    accounts: tuple[str, ...]
    columns: str
    list_page: ListPage
    detail: Detail
    tries: int = 3
    base: float = 2.0
    keep_errors: bool = False

    @property
    def schema(self) -> str:
        return f"account string, id string, {self.columns}, error string"

    def again(self, call: Callable):
        return with_backoff(call, self.tries, self.base)

    def walk(self, account: str, start: dict, end: dict | None = None) -> Iterator[tuple[Span, dict]]:
        """Pages after a position up to another, or to the last page there is, each with the position behind it.

        A position is a page's token and the number of its items already read, so that a last page may grow later.
        """
        token, seen = start["token"], start["seen"]
        while True:
            ids, after = self.again(lambda token=token: self.list_page(account, token))
            here = end is not None and token == end["token"]
            last = min(len(ids), end["seen"]) if here else len(ids)
            if here and last < end["seen"]:
                raise ValueError(f"{account}: a page has fewer items than were read of it; the listing must only grow at its end")
            at = {"token": token, "seen": last} if here or after is None else {"token": after, "seen": 0}
            yield Span(account, token, seen, last), at
            if here or after is None:
                if end is not None and not here:
                    raise ValueError(f"{account}: the page of a saved position is no longer listed")
                return
            token, seen = after, 0

    def rows(self, span: Span, names: list[str]) -> Iterator[tuple]:
        """One page is listed again where it is read; the driver keeps tokens only."""
        ids, _ = self.again(lambda: self.list_page(span.account, span.token))
        for item in ids[span.first : span.last]:
            try:
                found = self.again(lambda item=item: self.detail(span.account, item))
            except Exception as error:  # noqa: BLE001  what a remote raises is its own
                if not self.keep_errors:
                    raise
                yield (span.account, item, *(None for _ in names), str(error) or type(error).__name__)
                continue
            yield (span.account, item, *(found.get(n) for n in names), None)


START = {"token": None, "seen": 0}


def _names(schema: StructType) -> list[str]:
    return [f.name for f in schema.fields][2:-1]


class _Table(DataSourceReader):
    def __init__(self, remote: Remote, names: list[str]):
        self.remote, self.names = remote, names

    def partitions(self) -> list[InputPartition]:
        return [s for a in self.remote.accounts for s, _ in self.remote.walk(a, START) if s.first < s.last] or [Span("", None, 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.remote.rows(partition, self.names) if partition.first < partition.last else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, remote: Remote, names: list[str]):
        self.remote, self.names, self.at = remote, names, {}

    # Offsets are flat text by account: Spark stores them as JSON of primitive values.
    def initialOffset(self) -> dict:
        return {a: json.dumps(START) for a in self.remote.accounts}

    def latestOffset(self) -> dict:
        for account in self.remote.accounts:
            at = self.at.get(account, START)
            for _, at in self.remote.walk(account, at):
                pass
            self.at[account] = at
        return {a: json.dumps(p) for a, p in self.at.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A task a page, also for a batch that is run again after a failure: the log's positions alone decide."""
        spans = []
        for account, position in end.items():
            begin, stop = json.loads(start.get(account) or json.dumps(START)), json.loads(position)
            if begin != stop:
                spans += [s for s, _ in self.remote.walk(account, begin, stop) if s.first < s.last]
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.remote.rows(partition, self.names)


def register(spark: SparkSession, name: str, remote: Remote) -> str:
    """Makes ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read the remote; returns the name.

    Rows are (account, id, the remote's columns, error). A page is a task, its items are fetched there one by one and tried again
    ``tries`` times; then the job fails, or with ``keep_errors`` the item is a row with the error and no values. A stream's offset
    is a page token and a count by account, kept in its checkpoint: what a failed batch had read is read again by that batch
    alone (with ``availableNow`` by a run of its own), and an account that was added starts at its beginning. The listing has to be stable and to grow at its end only (oldest first);
    where a saved position has gone the stream fails rather than lose items. Ids given twice are two rows (``remote.meetings`` takes
    each once); an account without items gives none.
    """

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return remote.schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Table(remote, _names(schema))

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return _Stream(remote, _names(schema))

    spark.dataSource.register(Source)
    return name
