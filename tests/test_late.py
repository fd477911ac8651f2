"""Late rows go to a table of their own, whatever is run again."""

from __future__ import annotations

import datetime as dt

import pytest
from lodegraph.streaming import events as streams
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(hours):
    return None if hours is None else T0 + dt.timedelta(hours=hours)


def put(spark, folder, *rows):
    spark.createDataFrame([(i, at(h), "x") for i, h in rows], "id int, ts timestamp, extra string").coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder):
    q = streams.split_late(streams.table_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, 1000), "ts", "2 HOURS", str(folder))
    q.awaitTermination()
    return tuple(sorted(r.id for r in spark.read.schema("id int, extra string").parquet(f"{folder}/{kind}").collect()) for kind in ("on_time", "late"))


def test_late_rows_are_kept(spark, tmp_path):
    put(spark, tmp_path, (1, 10), (2, 0), (3, None))
    assert run(spark, tmp_path) == ([1, 2], [3])  # no batch before: only a row without a time is late
    put(spark, tmp_path, (4, 8), (5, 7.99), (6, 30), (7, 1))
    assert run(spark, tmp_path) == ([1, 2, 4, 6], [3, 5, 7])
    put(spark, tmp_path, (8, 29), (9, 20), (10, None))
    assert run(spark, tmp_path) == ([1, 2, 4, 6, 8], [3, 5, 7, 9, 10])
    assert run(spark, tmp_path) == ([1, 2, 4, 6, 8], [3, 5, 7, 9, 10])


def test_a_batch_that_fails_half_way_is_written_once(spark, tmp_path, monkeypatch):
    put(spark, tmp_path, (1, 10))
    run(spark, tmp_path)
    put(spark, tmp_path, (2, 40), (3, 1))
    whole = F.max
    monkeypatch.setattr(streams.F, "max", lambda c: whole(c) if c == "newest" else (_ for _ in ()).throw(OSError("lost")))  # after both tables, before the mark
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path)
    monkeypatch.undo()
    assert run(spark, tmp_path) == ([1, 2], [3])
    put(spark, tmp_path, (4, 39), (5, 37))
    assert run(spark, tmp_path) == ([1, 2, 4], [3, 5])
