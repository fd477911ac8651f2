"""Window-style operators: turns, compaction, runs, sequence numbers, history caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turn_groups(messages: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """Adds turn_id: a user message that follows another role begins a turn."""
    w = Window.partitionBy(conv).orderBy(order)
    begins = (F.col(role) == "user") & F.coalesce(F.lag(role).over(w) != "user", F.lit(True))
    flagged = messages.withColumn("_begins", begins.cast("int"))
    return flagged.withColumn("turn_id", F.sum("_begins").over(w)).drop("_begins")


def step_groups(messages: DataFrame, conv: str, order: str, step: str) -> DataFrame:
    """Adds turn_id: a turn ends where a step that is not null differs from the last one; nulls stay with the turn."""
    w = Window.partitionBy(conv).orderBy(order)
    held = F.last(step, ignorenulls=True).over(w)
    steps = messages.withColumn("_step", held)
    changed = F.coalesce(F.col("_step") != F.lag("_step").over(w), F.col("_step").isNotNull() & F.lag("_step").over(w).isNull() & (F.row_number().over(w) > 1))
    return steps.withColumn("_new", changed.cast("int")).withColumn("turn_id", F.sum("_new").over(w)).drop("_step", "_new")


def compact_turns(turns: DataFrame, conv: str, turn: str, tokens: str, budget: int, keep_last: int = 2) -> DataFrame:
    """Whole turns from the newest back while they fit the budget; the last ``keep_last`` stay anyway."""
    back = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    suffix = F.sum(tokens).over(back.rowsBetween(Window.unboundedPreceding, 0))
    marked = turns.withColumns({"suffix_tokens": suffix, "from_end": F.row_number().over(back)})
    return marked.where((F.col("suffix_tokens") <= budget) | (F.col("from_end") <= keep_last))


def run_segments(log: DataFrame, key: str, ts: str, command: str, last_command: str, gap_seconds: int) -> DataFrame:
    """Adds run: a run ends after ``last_command`` or before a gap, between times in whole seconds, rounded; rows without a time come last."""
    w = Window.partitionBy(key).orderBy(F.col(ts).asc_nulls_last(), F.col(command).asc_nulls_last())
    seconds = lambda t: F.rint(F.unix_micros(t.cast("timestamp")) / 1e6).cast("long")
    before, gap = F.lag(command).over(w), seconds(F.col(ts)) - seconds(F.lag(ts).over(w))
    starts = F.coalesce((before == last_command) | (gap > gap_seconds), F.lit(False))
    return log.withColumn("_starts", starts.cast("int")).withColumn("run", F.sum("_starts").over(w)).drop("_starts")


def sequence_ids(batches: DataFrame, ts: str, tie: str, prefix: str = "BATCH") -> DataFrame:
    """BATCH-yyyymmdd-NNN by time within each day."""
    day = F.to_date(ts)
    n = F.row_number().over(Window.partitionBy(day).orderBy(ts, tie))
    return batches.withColumn("batch_id", F.concat_ws("-", F.lit(prefix), F.date_format(ts, "yyyyMMdd"), F.lpad(n.cast("string"), 3, "0")))


def newest(frame: DataFrame, key: str | None, order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each key, or of all."""
    if key is None:
        return frame.orderBy(*order).limit(n)
    return frame.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def thinned(positions: Column, least: int) -> Column:
    """Greedy: keeps a position that is at least ``least`` from the last one kept."""
    add = lambda kept, p: F.when((F.size(kept) == 0) | (p - F.element_at(kept, -1) >= least), F.concat(kept, F.array(p))).otherwise(kept)
    return F.aggregate(F.sort_array(positions), F.array().cast("array<int>"), add)


def seen(events: DataFrame, key: str, ts: str, source: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("n"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count_distinct(source).alias("n_sources"))


def batches_of(files: DataFrame, hint: str, order: str, most: int) -> DataFrame:
    """Slices of at most ``most`` files within each hint."""
    at = F.row_number().over(Window.partitionBy(hint).orderBy(order)) - 1
    return files.withColumn("slice", F.floor(at / most))
