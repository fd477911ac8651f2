"""State machines, retries, remote pages."""

from __future__ import annotations

import pytest
from lodegraph.sources import remote
from lodegraph.streaming import machines as M
from pyspark.sql import functions as F


def test_turn_machine():
    state = None
    for event, want in (("receive", "received"), ("accept", "received"), ("plan", "planned"), ("run", "running"), ("pause", "paused"), ("resume", "running"), ("review", "reviewing"), ("accept", "done"), ("fail", "done")):
        state, _ = M.TURN.step(state, event)
        assert state == want
    assert M.TURN.step("reviewing", "reject", 3) == ("reviewing", False) and M.TURN.step("planned", "fail") == ("failed", True)
    assert {"idle", "done", "paused"} <= M.TURN.states()


def test_machine_stream(spark, tmp_path):
    rows = [("a", "receive", 1), ("a", "plan", 2), ("b", "plan", 1), ("a", "run", 3)]
    spark.createDataFrame(rows, "key string, event string, at long").coalesce(1).write.parquet(f"{tmp_path}/r")
    stream = spark.readStream.schema("key string, event string, at long").parquet(f"{tmp_path}/r")
    q = M.machine_states(stream).writeStream.format("memory").queryName("turns").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("turns").collect()} == {("a", "running", 3, 0), ("b", "idle", 0, 1)}


def test_jobs(spark):
    states = spark.createDataFrame([("a", "running"), ("b", "done")], "key string, state string")
    assert {(r["key"], r["state"], r["reason"]) for r in M.reaped(states).collect()} == {("a", "failed", "stale_state_recovery"), ("b", "done", None)}
    jobs = spark.createDataFrame([("x", "active", 5, 20), ("y", "active", 50, 60), ("z", "waiting", 0, 0)], "slug string, status string, timeout_at int, lock_until int")
    assert {r["slug"]: r["status"] for r in M.timed_out(jobs, F.lit(10)).collect()} == {"x": "dead", "y": "active", "z": "waiting"}
    assert [r["slug"] for r in M.enqueue(jobs, spark.createDataFrame([("x",), ("w",)], "slug string")).collect()] == ["w"]
    assert spark.range(1).select(M.eta(F.lit(10), F.lit(40), F.lit(1200))).first()[0] == "01:00"
    assert [M.backpressure(n) for n in (1, 60, 150, 500)] == [4, 3, 2, 1]


def test_backoff():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert M.with_backoff(call, wait=waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(OSError):
        M.with_backoff(lambda: (_ for _ in ()).throw(OSError()), tries=2, wait=waits.append)


def test_remote_pages(spark):
    def fetch(account, cursor):
        at = int(cursor or 0)
        return [{"id": f"{account}{at}", "title": "t"}], str(at + 1) if at < 2 else None

    accounts = spark.createDataFrame([("a",), ("b",)], "account string")
    pages = remote.paged(accounts, fetch, "id string, title string")
    assert {r["id"] for r in pages.collect()} == {"a0", "a1", "a2", "b0", "b1", "b2"}
    done = spark.createDataFrame([("a0",)], "id string")
    assert remote.meetings(pages, done).count() == 5
    assert {r["account"]: (r["total"], r["pending"]) for r in remote.account_summary(pages, done).collect()} == {"a": (3, 2), "b": (3, 3)}
