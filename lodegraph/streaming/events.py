"""Structured Streaming operators: file sources, deduplication with a TTL, debouncing, totals, registry state, leases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lodegraph.operators.dedup import hour_key
from lodegraph.streaming.registry import verdict

IGNORED = r"(^|/)([._~].*|.*\.(tmp|part|crdownload|swp))$"


def files(spark: SparkSession, folder: str, per_trigger: int = 1000, pattern: str = "*") -> DataFrame:
    """New files of a folder as (path, modificationTime, length, content); partial and hidden ones are ignored."""
    found = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return found.where(~F.col("path").rlike(IGNORED))


def table_stream(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def once_within(events: DataFrame, key: Column, ts: str, days: int = 30) -> DataFrame:
    """The first event of each key; state is kept for ``days`` of event time."""
    return events.withColumn("_key", key).withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def meetings_once(events: DataFrame, title: str, ts: str, days: int = 30) -> DataFrame:
    return once_within(events, hour_key(F.col(title), F.col(ts)), ts, days)


def hourly(events: DataFrame, ts: str, *keys: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), *keys).agg(F.count("*").alias("n"))


def debounced(events: DataFrame, key: str, ts: str, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """One row per burst of a key: events nearer than ``quiet`` are one burst."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, quiet), key).agg(F.count("*").alias("n"), F.max(ts).alias("last_ts"))


def running_totals(events: DataFrame, phase: str, value: str) -> DataFrame:
    """For update or complete output: counts and sums by phase so far."""
    return events.groupBy(phase).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


REGISTRY_OUT = "key string, body_hash string, words int, verdict string"
REGISTRY_STATE = "body_hash string, words int"


def registry_verdicts(incoming: DataFrame) -> DataFrame:
    """Stream of (key, body_hash, words) with the verdict against the key's state: process, skip or incremental.

    Rows have no time, so they go by words within a batch; with times use ``registry.registry_by_time``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        for batch in batches:
            for row in batch.sort_values(["words", "body_hash"]).itertuples(index=False):
                found = verdict(last, row.body_hash, int(row.words))
                last = last if found == "skip" else (row.body_hash, int(row.words))
                out.append((key[0], row.body_hash, int(row.words), found))
        state.update(last)
        yield pd.DataFrame(out, columns=["key", "body_hash", "words", "verdict"])

    return incoming.groupBy("key").applyInPandasWithState(step, REGISTRY_OUT, REGISTRY_STATE, "append", GroupStateTimeout.NoTimeout)


LEASE_OUT = "job string, status string, attempts int, stalled int"
LEASE_STATE = "status string, attempts int, stalled int, lock_until long"
MAX_STALLED = 3


def lease_step(state: tuple | None, event: str, at: int, lease_ms: int, most: int = MAX_STALLED) -> tuple:
    """Next (status, attempts, stalled, lock_until) of a job: enqueue, claim, beat, finish, fail or tick.

    A lease that ran out puts the job back, or ends it as dead once it stalled ``most`` times.
    """
    status, attempts, stalled, until = state or ("none", 0, 0, 0)
    if status == "active" and at >= until:
        stalled += 1
        status = "waiting" if stalled < most else "dead"
    if event == "enqueue" and status in ("none", "done", "dead"):
        return ("waiting", attempts, 0, 0)
    if event == "claim" and status == "waiting":
        return ("active", attempts + 1, stalled, at + lease_ms)
    if event == "beat" and status == "active":
        return (status, attempts, stalled, at + lease_ms)
    if event in ("finish", "fail") and status == "active":
        return ("done" if event == "finish" else "waiting", attempts, stalled, 0)
    return (status, attempts, stalled, until)


def job_states(events: DataFrame, lease_ms: int = 30_000) -> DataFrame:
    """Stream of (job, event, at in ms) to the job's state after each batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        for batch in batches:
            for row in batch.sort_values("at").itertuples(index=False):
                now = lease_step(now, row.event, int(row.at), lease_ms)
        state.update(now)
        yield pd.DataFrame([(key[0], now[0], now[1], now[2])], columns=["job", "status", "attempts", "stalled"])

    return events.groupBy("job").applyInPandasWithState(step, LEASE_OUT, LEASE_STATE, "update", GroupStateTimeout.NoTimeout)


def reindex(stream: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a sink function for each micro-batch of what is there, then stops."""
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_late(stream: DataFrame, ts: str, late: str, folder: str) -> StreamingQuery:
    """Runs over what is there and stops: rows in time to ``folder``/on_time, rows behind the watermark to ``folder``/late.

    Spark's own operators drop late rows without a trace; here they are kept. The watermark of a batch is ``late`` behind the newest
    time of the batches before it. Every batch writes tables of its own number, its newest time among them, and overwrites them
    when it is run again, so failures neither lose nor repeat rows. Rows without a time are late. Extra columns are kept; the name ``batch`` is taken.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        spark.createDataFrame([(batch,)], "batch long").write.mode("overwrite").parquet(f"{folder}/known/first")  # so that there is always a table
        marks = spark.read.schema("batch long, newest timestamp").parquet(f"{folder}/known/*").where(F.col("batch") < batch)
        mark = marks.agg(F.max("newest").alias("newest")).first().newest
        behind = F.lit(False) if mark is None else F.col(ts) < F.lit(mark) - F.expr(f"INTERVAL {late}")
        held = rows.persist()
        split = held.withColumn("_late", F.coalesce(behind, F.lit(True)) if mark is not None else F.col(ts).isNull())
        split.where("NOT _late").drop("_late").write.mode("overwrite").parquet(f"{folder}/on_time/batch={batch}")
        split.where("_late").drop("_late").write.mode("overwrite").parquet(f"{folder}/late/batch={batch}")
        held.agg(F.lit(batch).cast("long").alias("batch"), F.max(ts).cast("timestamp").alias("newest")).write.mode("overwrite").parquet(f"{folder}/known/batch-{batch}")
        held.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
