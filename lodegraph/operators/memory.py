"""Agent memory: ranking, search, pruning, statistics over entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import text as T

MOST, LEAST_SCORE = 200, 0.1


def scored(entries: DataFrame, now: Column) -> DataFrame:
    """Adds recency and the composite score to (agent, content, importance, references, last_seen, pinned, scope)."""
    days = (F.unix_timestamp(now) - F.unix_timestamp(F.col("last_seen").cast("timestamp"))) / 86_400
    with_age = entries.withColumn("recency", T.recency(days))
    return with_age.withColumn("composite", T.composite_score(F.col("importance"), F.col("recency"), F.col("references")))


def search(entries: DataFrame, query: str, k: int) -> DataFrame:
    """Half the share of query words that an entry has, half its composite score; the best k with a common word."""
    asked = F.array_distinct(T.tokens(F.lit(query)))
    common = F.size(F.array_intersect(asked, T.tokens(F.col("content"))))
    score = 0.5 * common / F.greatest(F.size(asked), F.lit(1)) + 0.5 * F.col("composite")
    return entries.withColumn("score", score).where(common > 0).orderBy(F.round("score", 9).desc(), "content").limit(k)


def prune(entries: DataFrame, most: int = MOST, least: float = LEAST_SCORE) -> DataFrame:
    """Pinned and core entries stay; others with a low score go, then the lowest beyond ``most`` per agent."""
    safe = F.col("pinned") | (F.col("scope") == "core")
    order = Window.partitionBy("agent").orderBy(F.when(safe, 0).otherwise(1), F.col("composite").desc(), "content")
    ranked = entries.where(safe | (F.col("composite") >= least)).withColumn("_rn", F.row_number().over(order))
    return ranked.where(safe | (F.col("_rn") <= most)).drop("_rn")


def stats(entries: DataFrame) -> DataFrame:
    return entries.rollup("scope").agg(F.count("*").alias("n"), F.count_if("pinned").alias("pinned"), F.sum("references").alias("references"), F.round(F.avg("importance"), 4).alias("importance"))


def within_budget(entries: DataFrame, most_chars: int) -> DataFrame:
    """Lines ``- [scope] content`` by score until the first that would exceed the budget."""
    line = F.concat(F.lit("- ["), "scope", F.lit("] "), "content")
    order = Window.partitionBy("agent").orderBy(F.col("composite").desc(), "content").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("line", line).withColumn("used", F.sum(F.length("line") + 1).over(order)).where(F.col("used") <= most_chars)
