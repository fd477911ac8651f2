"""Registry of what came in by key: verdicts in the order of event time over all batches, entries that expire."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State of this kind lives in RocksDB; set it before the stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "key string, at long, body_hash string, words int, verdict string, previous_words int"


def verdict(last: tuple[str, int] | None, body_hash: str, words: int) -> str:
    """Against the registered (body_hash, words): process what is new or of equal length but changed, incremental what has grown, skip copies and what has shrunk."""
    if last is None:
        return "process"
    if last[0] == body_hash or words < last[1]:
        return "skip"
    return "incremental" if words > last[1] else "process"


class _Registry(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "at long, body_hash string, words int")
        self.waiting = handle.getListState("waiting", "at long, body_hash string, words int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Nothing is decided yet: an earlier row may still come, until the watermark has passed.
        came = [(int(a), h, int(w)) for batch in rows for a, h, w in zip(batch["at"], batch["body_hash"], batch["words"])]
        if came:
            self.waiting.appendList(came)
            self.handle.registerTimer(min(came)[0])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get(), key=lambda r: (r[0], r[2], r[1])) if self.waiting.exists() else []
        entry = tuple(self.entry.get()) if self.entry.exists() else None
        due, rest, out = [r for r in held if r[0] <= now], [r for r in held if r[0] > now], []
        for at, body_hash, words in due:
            last = None if entry is None or at - entry[0] > self.keep_ms else entry[1:]
            decided = verdict(last, body_hash, words)
            if decided != "skip":
                entry = (at, body_hash, words)
            out.append((key[0], at, body_hash, words, decided, None if last is None else last[1]))
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put([tuple(r) for r in rest])
                self.handle.registerTimer(rest[0][0])
        if entry is not None and now - entry[0] > self.keep_ms and not rest:
            self.entry.clear()
        elif entry is not None and due:
            self.entry.update(entry)
            self.handle.registerTimer(entry[0] + self.keep_ms + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "body_hash", "words", "verdict", "previous_words"]).astype({"previous_words": "Int32", "words": "int32"})

    def close(self) -> None:
        pass


def registry_by_time(incoming: DataFrame, ts: str = "ts", late: str = "1 hour", keep: timedelta = timedelta(days=365)) -> DataFrame:
    """Stream of (key, ts, body_hash, words) to (key, at, body_hash, words, verdict, previous_words), in append mode.

    A row is decided once the watermark (``late`` behind the newest) has passed it, against the entry that rows before it left:
    ``verdict``. So the batches that rows come in, and their order, change nothing; rows later than the watermark are dropped by Spark.
    Rows of one time go by words, then hash. An entry expires ``keep`` after the row that was registered last: a row after that is new,
    and a timer takes the entry out of the state. A key keeps one entry and the rows that wait. Rows without a key, time, hash or
    words are no input. The session needs ``STATE_STORE``.
    """
    rows = incoming.where(F.col("key").isNotNull() & F.col(ts).isNotNull() & F.col("body_hash").isNotNull() & F.col("words").isNotNull())
    timed = rows.select("key", F.col(ts).alias("ts"), F.unix_millis(ts).alias("at"), "body_hash", F.col("words").cast("int").alias("words")).withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(_Registry(int(keep.total_seconds() * 1000)), OUT, "Append", "EventTime")
