"""Streams run over what a table holds, to the end, and return their result as a table; SQL is the batch equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.plans.catalogue import ORACLE_SQL, QUERIES
from lodegraph.session import shared_dir
from lodegraph.streaming import events as streams
from lodegraph.streaming import registry


def stream_query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return register


def events_stream(spark: SparkSession, sf_dir: str, per_trigger: int = 100) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, as the table may be one file and streams read folders or patterns.
    return streams.table_stream(spark, f"{sf_dir}/event[s].parquet", schema, per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))


def finished(frame: DataFrame, mode: str) -> DataFrame:
    """The rows of a stream that has read all there is, from a table in the shared folder or, if they are totals, in memory."""
    spark = frame.sparkSession
    name = f"stream_{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/{name}"
    if mode == "append":
        q = frame.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(frame.schema).parquet(f"{folder}/out")
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@stream_query("stream_running_totals", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _totals(spark, sf_dir):
    return finished(streams.running_totals(events_stream(spark, sf_dir), "event_type", "value"), "complete").select("event_type", "n", F.round("total", 4).alias("total"))


@stream_query("stream_hourly", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def _hourly(spark, sf_dir):
    out = finished(streams.hourly(events_stream(spark, sf_dir), "ts", "event_type"), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@stream_query("stream_first_of_key", "SELECT DISTINCT user_id, event_type FROM events")
def _once(spark, sf_dir):
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type")
    return finished(streams.once_within(events_stream(spark, sf_dir), key, "ts", 365).select("user_id", "event_type"), "append")


@stream_query("stream_registry_verdicts", """WITH o AS (SELECT user_id::VARCHAR AS key, md5(event_type) AS h, (value * 10)::INT AS words FROM events WHERE event_type IN ('signup')) SELECT key, count(*) AS n FROM o GROUP BY key""")
def _registry(spark, sf_dir):
    rows = events_stream(spark, sf_dir).where("event_type IN ('signup')").select(F.col("user_id").cast("string").alias("key"), F.md5("event_type").alias("body_hash"), (F.col("value") * 10).cast("int").alias("words"))
    return finished(streams.registry_verdicts(rows), "append").groupBy("key").agg(F.count("*").alias("n"))


@stream_query("stream_job_states")
def _jobs(spark, sf_dir):
    event = F.when(F.col("event_type") == "signup", "enqueue").when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "view", "beat").when(F.col("event_type") == "purchase", "finish").otherwise("tick")
    rows = events_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("job"), event.alias("event"), F.unix_millis("ts").alias("at"))
    return finished(streams.job_states(rows, 3_600_000), "update")


#: All files in one batch: files are not in the order of their times, so rows of a second batch could be behind the watermark.
ALL_FILES = 1_000_000


@stream_query("stream_registry_by_time", """WITH o AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS at_ms, md5(event_type || ' ' || floor(value)::BIGINT) AS body_hash, floor(value)::INT AS words FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ms, words, body_hash) AS i FROM o WHERE at_ms <= (SELECT max(at_ms) - 3600000 FROM o)),
p AS (SELECT *, max(words) OVER w AS previous_words, arg_max(body_hash, words::BIGINT * 10000000000 + i) OVER w AS h FROM n WINDOW w AS (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT key, at_ms, body_hash, words, previous_words, CASE WHEN h IS NULL THEN 'process' WHEN h = body_hash OR words < previous_words THEN 'skip' WHEN words > previous_words THEN 'incremental' ELSE 'process' END AS verdict FROM p""")
def _registry_by_time(spark, sf_dir):
    spark.conf.set(*registry.STATE_STORE)
    rows = events_stream(spark, sf_dir, ALL_FILES).select(F.col("user_id").cast("string").alias("key"), "ts", F.md5(F.concat_ws(" ", "event_type", F.floor("value").cast("string"))).alias("body_hash"), F.floor("value").cast("int").alias("words"))
    return finished(registry.registry_by_time(rows), "append").withColumnRenamed("at", "at_ms")


@stream_query("stream_bursts", """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM o)
SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM s GROUP BY user_id, burst
HAVING epoch_us(max(ts)) + 7200000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 FROM events) - 10000000""")
def _bursts(spark, sf_dir):
    out = finished(streams.debounced(events_stream(spark, sf_dir, ALL_FILES), "user_id", "ts", "2 hours"), "append")
    return out.select("user_id", "n", F.unix_micros("session_window.start").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@stream_query("stream_late_rows", """WITH o AS (SELECT event_id, ts, event_id % 3 AS part FROM events),
m AS (SELECT part, max(ts) AS newest FROM o GROUP BY part)
SELECT event_id, coalesce(ts < (SELECT max(newest) FROM m WHERE m.part < o.part) - INTERVAL 3 DAY, false) AS late FROM o""")
def _late(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    folder = f"{shared_dir(spark)}/late_{uuid.uuid4().hex}"
    for part in range(3):  # what comes in three runs of the stream
        events.where(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{folder}/in")
        streams.split_late(streams.table_stream(spark, f"{folder}/in", events.schema, ALL_FILES), "ts", "3 DAYS", folder).awaitTermination()
    read = lambda kind: spark.read.schema(events.schema).parquet(f"{folder}/{kind}").select("event_id", F.lit(kind == "late").alias("late"))
    return read("on_time").union(read("late"))
