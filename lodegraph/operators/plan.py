"""Plan DAGs: levels, batches, critical paths, checks; nodes(id, minutes), edges(source, target)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import cut


class CycleError(ValueError):
    """The plan has a cycle."""


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): 0 without predecessors, else one more than the highest of them. Plans are small: one round per level."""
    left = cut(nodes.select("id").distinct())
    pending = cut(edges.select("source", "target").distinct())
    placed = None
    level = 0
    while not left.isEmpty():
        waiting = pending.select(F.col("target").alias("id")).distinct()
        ready = cut(left.join(waiting, "id", "left_anti").select("id", F.lit(level).alias("level")))
        if ready.isEmpty():
            raise CycleError("the plan has a cycle")
        placed = ready if placed is None else placed.unionByName(ready)
        left = cut(left.join(ready, "id", "left_anti"))
        pending = cut(pending.join(ready.select(F.col("id").alias("source")), "source", "left_anti"))
        level += 1
    return placed if placed is not None else nodes.select("id", F.lit(0).alias("level"))


def batches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per level: its nodes and the longest of them; the sum over levels is the wall time."""
    at = levels(nodes, edges).join(nodes, "id")
    return at.groupBy("level").agg(F.count("*").alias("n_nodes"), F.max("minutes").alias("minutes"))


def ready(nodes: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    """Nodes not done whose predecessors all are."""
    waiting = edges.join(done.select(F.col("id").alias("source")), "source", "left_anti").select(F.col("target").alias("id")).distinct()
    return nodes.join(done.select("id"), "id", "left_anti").join(waiting, "id", "left_anti")


def critical_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, finish): earliest finish of each node; the largest is the length of the critical path."""
    at = cut(levels(nodes, edges).join(nodes, "id"))
    top = at.agg(F.max("level")).first()[0] or 0
    finish = at.where("level = 0").select("id", F.col("minutes").alias("finish"))
    for level in range(1, top + 1):
        start = edges.join(finish, F.col("source") == F.col("id")).groupBy("target").agg(F.max("finish").alias("start"))
        now = at.where(F.col("level") == level).join(start, F.col("id") == F.col("target"))
        finish = cut(finish.unionByName(now.select("id", (F.col("start") + F.col("minutes")).alias("finish"))))
    return finish


def stalled(running: DataFrame, plan: DataFrame, least: float = 10.0, factor: float = 2.0) -> DataFrame:
    """Running nodes (id, elapsed) that take longer than their estimate allows."""
    allowed = F.greatest(F.lit(least), F.coalesce("minutes", F.lit(0.0)) * factor)
    return running.join(plan, "id", "left").withColumn("allowed", allowed).where(F.col("elapsed") > F.col("allowed"))


def contract(produced: DataFrame, consumed: DataFrame, key: str = "id") -> DataFrame:
    """Ids that are consumed but not produced (phantom) or produced but not consumed (dead)."""
    both = produced.select(key).distinct().withColumn("p", F.lit(True)).join(consumed.select(key).distinct().withColumn("c", F.lit(True)), key, "full_outer")
    return both.where("p IS NULL OR c IS NULL").select(key, F.when(F.col("p").isNull(), "phantom").otherwise("dead").alias("problem"))
