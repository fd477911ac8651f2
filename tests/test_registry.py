"""Registry verdicts by event time: whatever the batches, equal to one pass in the order of time."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from lodegraph.session import importable
from lodegraph.streaming import registry

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "key string, ts timestamp, body_hash string, words int, extra string"


def in_order(rows, keep_s):
    """Plain pass over each key's rows, oldest first."""
    state, out = {}, set()
    for key, ts, body, words, _ in sorted(rows, key=lambda r: (r[1], r[3], r[2])):
        last = state.get(key)
        last = None if last and (ts - last[0]).total_seconds() > keep_s else last
        found = "process" if last is None else "skip" if body == last[1] or words < last[2] else "incremental" if words > last[2] else "process"
        if found != "skip":
            state[key] = (ts, body, words)
        out.add((key, int(ts.timestamp() * 1000), body, words, found, last[2] if last else None))
    return out


def test_verdicts():
    assert [registry.verdict(*a) for a in ((None, "a", 1), (("a", 5), "a", 9), (("a", 5), "b", 9), (("a", 5), "b", 5), (("a", 5), "b", 4))] == ["process", "skip", "incremental", "process", "skip"]


@pytest.mark.parametrize("batches", [1, 4])
def test_order_of_batches_changes_nothing(spark, tmp_path, batches):
    importable(spark)
    kept = spark.conf.get(registry.STATE_STORE[0])
    spark.conf.set(*registry.STATE_STORE)
    rng = random.Random(batches)
    hour, keep = 3600, 20 * 3600
    rows = []
    for _ in range(160):  # a hot key, ties of time, repeated rows; a batch reaches back by less than the watermark's delay
        at = rng.randrange(0, 96) * hour
        rows.append((rng.choice(["hot", "hot", "b", "c"]), T0 + dt.timedelta(seconds=at), rng.choice("xyz"), rng.randrange(1, 6), "e"))
    rows += rows[:5]
    rows.sort(key=lambda r: (r[1] - T0).total_seconds() + rng.randrange(0, 5 * hour))
    end = T0 + dt.timedelta(hours=200)
    step = len(rows) // batches + 1
    for i in range(batches):
        part = rows[i * step : (i + 1) * step] + [(None, T0, "x", 1, "e"), ("b", None, "x", 1, "e"), ("b", T0, None, 1, "e"), ("b", T0, "x", None, "e")]
        part += [("end", end, "x", 1, "e")] if i == batches - 1 else []
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        out = registry.registry_by_time(stream, late="6 hours", keep=dt.timedelta(seconds=keep))
        # Each run is a restart: state and watermark come from the checkpoint.
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        q.awaitTermination(200)
    spark.conf.set(registry.STATE_STORE[0], kept)
    found = [tuple(r) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").select("key", "at", "body_hash", "words", "verdict", "previous_words").collect()]
    want = in_order(rows, keep)
    assert set(found) == want and len(found) == len(rows)
    assert {v for _, _, _, _, v, _ in want} == {"process", "skip", "incremental"} and sum(p is None for *_, p in want) > 3  # some expired
