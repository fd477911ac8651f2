"""State machines, retries and progress for jobs that run as streams or in batches."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ANY = "*"


@dataclass(frozen=True)
class Transition:
    """From a state (or any) by an event to another, if the guard allows the number of tries so far."""

    source: str
    event: str
    target: str
    most_tries: int | None = None


@dataclass(frozen=True)
class Machine:
    """A table of transitions; exact ones go before those from any state, and final states are left by none."""

    start: str
    transitions: tuple[Transition, ...]
    final: frozenset[str] = frozenset()

    def step(self, state: str | None, event: str, tries: int = 0) -> tuple[str, bool]:
        """(next state, whether the event was taken)."""
        now = state or self.start
        if now in self.final:
            return now, False
        for source in (now, ANY):
            for t in self.transitions:
                if t.source == source and t.event == event and (t.most_tries is None or tries < t.most_tries):
                    return t.target, True
        return now, False

    def states(self) -> set[str]:
        return {self.start, *self.final, *(t.source for t in self.transitions if t.source != ANY), *(t.target for t in self.transitions)}


#: A turn of work: received, planned, run in steps, reviewed; it can fail or pause from anywhere.
TURN = Machine(
    "idle",
    (
        Transition("idle", "receive", "received"), Transition("received", "plan", "planned"), Transition("planned", "run", "running"),
        Transition("running", "step", "running"), Transition("running", "review", "reviewing"), Transition("reviewing", "reject", "running", most_tries=3),
        Transition("reviewing", "accept", "done"), Transition("paused", "resume", "running"), Transition(ANY, "pause", "paused"), Transition(ANY, "fail", "failed"),
    ),
    frozenset(("done", "failed")),
)


def machine_states(events: DataFrame, machine: Machine = TURN) -> DataFrame:
    """Stream of (key, event, at in ms) to (key, state, taken, refused) after each batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, taken, refused, tries = state.get if state.exists else (machine.start, 0, 0, 0)
        for batch in batches:
            for row in batch.sort_values("at").itertuples(index=False):
                now, ok = machine.step(now, row.event, tries)
                taken, refused = taken + ok, refused + (not ok)
                tries += ok and row.event == "reject"
        state.update((now, taken, refused, tries))
        yield pd.DataFrame([(key[0], now, taken, refused)], columns=["key", "state", "taken", "refused"])

    return events.groupBy("key").applyInPandasWithState(step, "key string, state string, taken int, refused int", "state string, taken int, refused int, tries int", "update", GroupStateTimeout.NoTimeout)


def reaped(states: DataFrame, final: tuple[str, ...] = ("done", "failed")) -> DataFrame:
    """Every state that is not final becomes failed, with the reason."""
    stale = ~F.col("state").isin(*final)
    return states.withColumns({"reason": F.when(stale, "stale_state_recovery"), "state": F.when(stale, "failed").otherwise(F.col("state"))})


def timed_out(jobs: DataFrame, now: Column) -> DataFrame:
    """Active jobs past their timeout whose lease still holds end as dead."""
    dead = (F.col("status") == "active") & (F.col("timeout_at") <= now) & (F.col("lock_until") > now)
    return jobs.withColumn("status", F.when(dead, "dead").otherwise(F.col("status")))


def enqueue(jobs: DataFrame, wanted: DataFrame, key: str = "slug") -> DataFrame:
    """Wanted keys that have no live job."""
    live = jobs.where(F.col("status").isin("waiting", "active")).select(key)
    return wanted.select(key).distinct().join(live, key, "left_anti")


def with_backoff(call: Callable[[], Any], tries: int = 3, base: float = 2.0, wait: Callable[[float], None] = time.sleep, jitter: random.Random | None = None) -> Any:
    """The call's result, tried again after base ** n seconds (and up to a tenth more); the last error is raised."""
    for n in range(1, tries + 1):
        try:
            return call()
        except Exception:  # noqa: BLE001  the caller's errors are its own
            if n == tries:
                raise
            wait(base**n * (1 + (jitter.random() / 10 if jitter else 0)))


def backpressure(queued: int) -> int:
    """Workers for a queue: fewer as it grows, so that what is behind can follow."""
    return 4 if queued < 50 else 3 if queued < 100 else 2 if queued < 200 else 1


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Time left as HH:MM; --:-- before the first is done."""
    left = (total - done) / (done / elapsed)
    return F.when((done > 0) & (elapsed > 0), F.format_string("%02d:%02d", F.floor(left / 3600).cast("int"), F.floor(left % 3600 / 60).cast("int"))).otherwise("--:--")


def cumulative_tokens(parts: DataFrame, key: str, order: str, tokens: str) -> DataFrame:
    return parts.withColumn("so_far", F.sum(tokens).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def by_slug(files: DataFrame, process: Callable[[pd.DataFrame], pd.DataFrame], schema: str, slug: str = "slug") -> DataFrame:
    """Files of a slug in order on one task, slugs side by side."""
    return files.groupBy(slug).applyInPandas(process, schema)
