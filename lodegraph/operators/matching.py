"""Order-dependent matching and merging."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.session import cut

SAME = 0.85



def match_band(score: Column) -> Column:
    return F.when(score >= 0.9, "EXACT").when(score >= 0.7, "STRONG").when(score >= 0.5, "POSSIBLE").when(score > 0, "WEAK").otherwise("NO_MATCH")


#: Pairs in all that are few enough for one last task; rounds go on while there are more.
LAST_PAIRS = 10_000


def greedy_one_to_one(scores: DataFrame, group: str, by_left: bool = False, last_pairs: int = LAST_PAIRS) -> DataFrame:
    """(group, left, right, score, band): pairs in order, each side at most once.

    The order is by score descending, left, right; ``by_left``: by left, then score descending, then right (each left in turn
    takes the best that is still free). It is found in rounds: a pair that comes first for both its sides is taken, and all
    others of these sides go, which is what the pairs one by one would give. Every round shuffles by group and side, so a
    group of any size is spread over tasks; when at most ``last_pairs`` are left in all, one task ends the work. Pairs with a
    null go; of equal pairs the best stays.
    """
    sides = scores.where(F.col("left").isNotNull() & F.col("right").isNotNull() & F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")))
    rest = cut(sides.select(F.col(group), F.col("left").cast("string"), F.col("right").cast("string"), F.col("score").cast("double")).groupBy(group, "left", "right").agg(F.max("score").alias("score")))
    order = F.struct(F.col("left"), (-F.col("score")).alias("s"), F.col("right")) if by_left else F.struct((-F.col("score")).alias("s"), F.col("left"), F.col("right"))

    def without(pairs: DataFrame, won: DataFrame, side: str) -> DataFrame:
        gone = won.select(F.col(group).alias("_g"), F.col(side).alias("_side"))
        return pairs.join(gone, F.col(group).eqNullSafe(F.col("_g")) & (F.col(side) == F.col("_side")), "left_anti")

    taken = None
    while (n := rest.count()) > last_pairs:
        keyed = rest.withColumn("key", order)
        of_left = keyed.groupBy(group, "left").agg(F.min("key").alias("key"))
        of_right = keyed.groupBy(F.col(group).alias("_g"), F.col("right").alias("_side")).agg(F.min("key").alias("_key"))
        first = of_left.join(of_right, F.col(group).eqNullSafe(F.col("_g")) & (F.col("key") == F.col("_key")))
        won = cut(first.select(group, "key.left", "key.right", (-F.col("key.s")).alias("score")))
        taken = won if taken is None else taken.unionByName(won)
        rest = cut(without(without(rest, won, "left"), won, "right"))
    if n:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            used, out = set(), []
            rows = pd.concat([*batches, pd.DataFrame(columns=[group, "left", "right", "score"])])
            by = ["left", "score", "right"] if by_left else ["score", "left", "right"]
            for r in rows.sort_values(by, ascending=[c != "score" for c in by], kind="stable").to_dict("records"):
                key = None if pd.isna(r[group]) else r[group]
                left, right = (key, 0, r["left"]), (key, 1, r["right"])
                if left not in used and right not in used:
                    used |= {left, right}
                    out.append(r)
            yield pd.DataFrame(out, columns=[group, "left", "right", "score"])

        last = rest.coalesce(1).mapInPandas(run, rest.schema)
        taken = last if taken is None else taken.unionByName(last)
    return (rest if taken is None else taken).withColumn("band", match_band(F.col("score")))


def first_independent(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(node) that the nodes (node, at, class), one by one in order of ``at``, would keep: each unless an earlier kept one is of
    its class or conflicts with it; ``conflicts``: (earlier, later).

    In rounds: a node that is the first open one of its class and has no open earlier conflict is kept; its class and what
    conflicts with it go. A round needs joins by node and class alone.
    """
    rest, edges, kept = cut(nodes.select("node", "at", "class")), cut(conflicts.select("earlier", "later").distinct()), None
    while not rest.isEmpty():
        first = rest.groupBy("class").agg(F.min("at").alias("at"))
        free = rest.join(first, ["class", "at"], "left_semi").join(edges.select(F.col("later").alias("node")), "node", "left_anti")
        free = cut(free.select("node", "class"))
        kept = free if kept is None else kept.unionByName(free)
        hit = edges.join(free.select(F.col("node").alias("earlier")), "earlier", "left_semi").select(F.col("later").alias("node"))
        rest = cut(rest.join(free.select("class"), "class", "left_anti").join(hit, "node", "left_anti"))
        still = rest.select("node")
        edges = cut(edges.join(still.withColumnRenamed("node", "earlier"), "earlier", "left_semi").join(still.withColumnRenamed("node", "later"), "later", "left_semi"))
    return (rest if kept is None else kept).select("node")


def consolidate(entries: DataFrame, same: float = SAME) -> DataFrame:
    """Merges an agent's near-identical memories (agent, content, importance, references, tags): the longer text, the higher
    importance, all references and tags. An agent's memories are few by the store's own cap, and their order matters."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for r in rows.sort_values("content").to_dict("records"):
            words = set(r["content"].lower().split())
            for k in kept:
                if len(words & k["w"]) >= same * max(1, len(words | k["w"])):
                    if len(r["content"]) > len(k["content"]):
                        k["content"], k["w"] = r["content"], words
                    k["importance"] = max(k["importance"], r["importance"])
                    k["references"] += r["references"]
                    k["tags"] = sorted({*k["tags"], *r["tags"]})
                    break
            else:
                kept.append({**r, "tags": sorted(set(r["tags"])), "w": words})
        return pd.DataFrame([{c: k[c] for c in ("agent", "content", "importance", "references", "tags")} for k in kept])

    return entries.select("agent", "content", "importance", "references", "tags").groupBy("agent").applyInPandas(run, "agent string, content string, importance double, references double, tags array<string>")


def merge_frameworks(rows: DataFrame, shared_steps: int = 3) -> DataFrame:
    """Drops frameworks (owner, name, steps) with the name of an earlier kept one or three steps (first 30 characters) in common.

    The order is by name, then steps. Conflicts are found by equal names and by prefixes of the steps in order of rarity: two
    sets with ``shared_steps`` in common share one of their first ``size - shared_steps + 1``. Candidates are compared whole.
    """
    clean = F.array_distinct(F.transform(F.filter(F.coalesce("steps", F.array().cast("array<string>")), lambda s: s.isNotNull()), lambda s: F.substring(F.lower(s), 1, 30)))
    owner = F.concat(F.col("owner").isNull().cast("string"), F.lit(":"), F.coalesce(F.col("owner").cast("string"), F.lit("")))
    at = F.row_number().over(Window.partitionBy("owner").orderBy("name", "steps"))
    held = rows.select("owner", "name", "steps", owner.alias("whose"), clean.alias("keys"), at.alias("at"))
    held = cut(held.withColumns({"node": F.concat(F.col("at").cast("string"), F.lit(":"), F.col("whose")), "class": F.struct(F.col("whose"), F.coalesce(F.lower("name"), F.lit("")).alias("name"))}))
    steps = held.select("node", "at", "whose", F.size("keys").alias("n"), F.explode("keys").alias("step")).where(F.col("n") >= shared_steps)
    rarity = steps.groupBy("whose", "step").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "step"))
    prefix = cut(steps.join(rarity, ["whose", "step"]).withColumn("place", place).where(F.col("place") <= F.col("n") - shared_steps + 1).select("whose", "step", "node", "at"))
    later = prefix.select("whose", "step", F.col("node").alias("later"), F.col("at").alias("later_at"))
    met = prefix.join(later, ["whose", "step"]).where("at < later_at").select(F.col("node").alias("earlier"), "later").distinct()
    both = met.join(held.select(F.col("node").alias("earlier"), F.col("keys").alias("k1")), "earlier").join(held.select(F.col("node").alias("later"), F.col("keys").alias("k2")), "later")
    conflicts = both.where(F.size(F.array_intersect("k1", "k2")) >= shared_steps)
    return held.join(first_independent(held, conflicts), "node", "left_semi").select("owner", "name", "steps")
