"""Aggregations over expert insights, costs, events and agent outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import text as T

PATTERN_BASE, PATTERN_SHARE, PATTERN_SMALL = 4, 0.15, 20
HIGH_CONFIDENCE = 0.8


def consensus(rows: DataFrame, least_experts: int = 2, floor: float = HIGH_CONFIDENCE) -> DataFrame:
    """Tags on which at least two experts are confident: (tag, expert, confidence) rows."""
    sure = rows.where(F.col("confidence") >= floor)
    return sure.groupBy("tag").agg(F.count_distinct("expert").alias("n_experts"), F.avg("confidence").alias("avg_confidence"), F.count("*").alias("n")).where(F.col("n_experts") >= least_experts)


def patterns(rows: DataFrame, base: int = PATTERN_BASE, most: int = 20) -> DataFrame:
    """The tags seen often: (tag, confidence) rows; at least ``base`` times, or a share of a small table if that is more."""
    n = rows.agg(F.count("*").alias("total"))
    least = F.when(F.col("total") < PATTERN_SMALL, F.greatest(F.lit(base), F.ceil(PATTERN_SHARE * F.col("total")))).otherwise(base)
    counted = rows.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    return counted.crossJoin(F.broadcast(n)).where(F.col("n") >= least).drop("total").orderBy(F.col("n").desc(), "tag").limit(most)


def merge_patterns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Adds counts of (tag, n, avg_confidence); confidences weigh by count."""
    both = old.unionByName(new)
    return both.groupBy("tag").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("avg_confidence")) / F.sum("n"), 4).alias("avg_confidence"))


def attribution(rows: DataFrame, expert: str) -> DataFrame:
    """Share of each expert in percent, halves to even."""
    counted = rows.groupBy(F.coalesce(F.col(expert), F.lit("unknown")).alias("expert")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("expert", "n", F.bround(100 * F.col("n") / F.col("total"), 0).alias("percentage"))


def cost_cube(facts: DataFrame, step: str, model: str, tokens: Column, cost: Column) -> DataFrame:
    """Cost by step, by model and in all, in one pass."""
    facts = facts.select(F.col(step).alias("step"), F.col(model).alias("model"), tokens.alias("tokens"), cost.alias("cost"))
    return facts.groupingSets([["step"], ["model"], []], "step", "model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 2).alias("cost"))


def budget(facts: DataFrame, step: str, cost: Column, limit: float) -> DataFrame:
    """Spent, remaining and share of a budget, with the dearest step."""
    per = facts.groupBy(F.col(step).alias("step")).agg(F.sum(cost).alias("c"))
    return per.agg(F.round(F.sum("c"), 2).alias("spent"), F.max_by("step", "c").alias("top_step")).select("spent", F.round(limit - F.col("spent"), 2).alias("remaining"), F.round(100 * F.col("spent") / limit, 2).alias("utilisation"), "top_step")


def phase_totals(events: DataFrame, key: str, phase: str) -> DataFrame:
    return events.groupBy(F.col(phase).alias("phase")).agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def convergence(outputs: DataFrame, group: str, agent: str, text_col: str = "text") -> DataFrame:
    """Mean Jaccard of agents' token sets over unordered pairs in each group; one agent alone agrees with itself.

    A group's agents are few (its speakers), its tokens many: sets are joined by group, not crossed.
    """
    sets = outputs.select(F.col(group).alias("g"), F.col(agent).alias("a"), F.explode_outer(T.tokens(F.col(text_col))).alias("t")).groupBy("g", "a").agg(F.collect_set("t").alias("s"))
    x, y = sets.alias("x"), sets.alias("y")
    pairs = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.a") < F.col("y.a"))).select(F.col("x.g").alias("g"), T.jaccard(F.col("x.s"), F.col("y.s")).alias("j"))
    found = pairs.groupBy("g").agg(F.avg("j").alias("mean"))
    return sets.select("g").distinct().join(found, "g", "left").select(F.col("g").alias(group), F.round(F.coalesce("mean", F.lit(1.0)), 4).alias("convergence"))


def dominance(outputs: DataFrame, group: str, agent: str, size: Column) -> DataFrame:
    """(max / mean - 1) / (n - 1) of the agents' shares, within 0 and 1."""
    per = outputs.groupBy(group, agent).agg(F.sum(size).alias("s"))
    raw = per.groupBy(group).agg(F.count("*").alias("n"), F.max("s").alias("top"), F.avg("s").alias("mean"))
    value = F.when((F.col("n") < 2) | (F.col("mean") == 0), 0.0).otherwise((F.col("top") / F.col("mean") - 1) / (F.col("n") - 1))
    return raw.select(group, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4).alias("dominance"))


def diversity(outputs: DataFrame, agent: str, text_col: str = "text") -> DataFrame:
    """Distinct tokens over tokens; counted per token first, so a hot agent is no one task's."""
    words = outputs.select(F.col(agent).alias("agent"), F.explode(T.tokens(F.col(text_col))).alias("t"))
    per = words.groupBy("agent", "t").agg(F.count("*").alias("c"))
    return per.groupBy("agent").agg(F.sum("c").alias("n_tokens"), F.count("*").alias("n_distinct")).select("agent", "n_tokens", "n_distinct", F.round(F.col("n_distinct") / F.col("n_tokens"), 4).alias("diversity"))


def density(flags: dict[str, tuple[Column, int]]) -> Column:
    """Number of thresholds that are met."""
    total = F.lit(0)
    for value, least in flags.values():
        total = total + (F.coalesce(value, F.lit(0)) >= least).cast("int")
    return total


def compare_runs(current: DataFrame, baseline: DataFrame, key: str, value: str, margin: float = 5.0) -> DataFrame:
    """Change in percent per key, and slower, faster, stable, new or removed."""
    both = current.select(key, F.col(value).alias("now")).join(baseline.select(key, F.col(value).alias("was")), key, "full_outer")
    change = F.when(F.col("was") != 0, (F.col("now") - F.col("was")) / F.col("was") * 100)
    verdict = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(change > margin, "slower").when(change < -margin, "faster").otherwise("stable")
    return both.select(key, F.round(change, 2).alias("change"), verdict.alias("verdict"))


def health(flags: list[Column], points: int = 20) -> Column:
    total = F.lit(0)
    for f in flags:
        total = total + F.when(f, points).otherwise(0)
    return total


def summary(frame: DataFrame, group: str, value: str) -> DataFrame:
    return frame.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.median(value), 4).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def last_n_deviation(batches: DataFrame, key: str, order: str, metric: str, n: int = 5, percent: float = 50.0) -> DataFrame:
    """Each batch against the mean of the n before it of the same key; ``anomaly`` where it is off by more than ``percent``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    off = (F.col(metric) - F.col("usual")) / F.col("usual") * 100
    with_mean = batches.withColumn("usual", F.avg(metric).over(w))
    return with_mean.withColumn("deviation", F.when(F.col("usual") != 0, off)).withColumn("anomaly", F.coalesce(F.abs("deviation") > percent, F.lit(False)))
