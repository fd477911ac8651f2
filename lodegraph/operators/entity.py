"""Entity resolution: aliases, fuzzy matching, role detection."""

from __future__ import annotations

from decimal import Decimal
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.functions.fuzzy import sequence_ratio, strip_accents
from lodegraph.session import cut

MERGE, REVIEW, ALIAS_REVIEW = 0.95, 0.85, 0.5
MAX_GRAM = 4
#: Ratios that names are compared down to, one after the other, before the floor.
STAGES = (0.95, 0.9)
STATUS_ACTIVE, STATUS_TRACKING = 10, 5


def alias_matches(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str, longest: int = MAX_GRAM) -> DataFrame:
    """(id, entity, gram): the longest n-gram of a text that is an alias (alias, entity), the earliest of equals; of entities of one alias the last.

    Aliases are written out first, so Spark knows their size and need not shuffle grams to few of them. What a gram is worth
    is one number (length, place, hash of the alias), so that a task keeps one row a text before anything is shuffled.
    """
    known = cut(aliases.where("alias IS NOT NULL").groupBy(F.lower("alias").alias("gram")).agg(F.max("entity").alias("entity")).withColumn("code", F.xxhash64("gram").cast("decimal(20,0)") + F.lit(Decimal(2**63))))
    sizes = sorted(r["n"] for r in known.select(F.size(F.split("gram", " ")).alias("n")).distinct().where(F.col("n") <= longest).collect())  # at most ``longest`` rows
    words = texts.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(T.WORD), F.lit(0)).alias("w")).where("w IS NOT NULL")
    following = F.arrays_zip(*(F.slice("w", i + 1, F.greatest(F.size("w"), F.lit(1))).alias(f"w{i}") for i in range(max(sizes, default=1))))
    rows = words.select("id", F.posexplode(following).alias("i", "at"))
    gram = lambda n: F.when(F.col(f"at.w{n - 1}").isNotNull(), F.concat_ws(" ", *(f"at.w{i}" for i in range(n))))
    every = F.array(*(F.struct((F.lit(n * 2**31) - F.col("i") - 1).alias("place"), gram(n).alias("gram")) for n in sizes or [1]))
    grams = rows.select("id", F.inline(every)).where("gram IS NOT NULL")
    worth = F.col("place").cast("decimal(12,0)") * F.lit(Decimal(2**64)) + F.col("code")
    best = grams.join(known.select("gram", "code"), "gram").groupBy("id").agg(F.max(worth).alias("worth"))
    return best.withColumn("code", (F.col("worth") % F.lit(Decimal(2**64))).cast("decimal(21,0)")).join(known.withColumn("code", F.col("code").cast("decimal(21,0)")), "code").select("id", "entity", "gram")


def _bigrams(text: Column) -> Column:
    """Pairs of neighbouring letters, each with which of its kind it is: a multiset as a set."""
    pairs = F.when(F.length(text) >= 2, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    numbered = lambda x, i: F.concat(x, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda y: y == x)).cast("string"))
    return F.transform(pairs, numbered)


def similar_pairs(names: DataFrame, candidates: DataFrame, floor: float) -> DataFrame:
    """(name, candidate) in lower case without marks as (a, b) too: all pairs whose sequence ratio may be ``floor``, and some below.

    A ratio of ``floor`` is M >= floor * L / 2 matched letters of the L of both names. M is at most the shorter length, and
    lies in at most L - 2M + 1 blocks, so both names share 3M - L - 1 bigrams at least. Names whose bound is t share one of
    their first n - t + 1 bigrams in any common order, here the rarest first. Names too short for it meet by length.
    """
    span, rate = floor / (2 - floor), 1.5 * floor - 1
    n = names.select("name").where("name IS NOT NULL").distinct().withColumn("a", strip_accents("name"))
    c = candidates.select(F.col("name").alias("candidate")).where("candidate IS NOT NULL").distinct().withColumn("b", strip_accents("candidate"))
    slack = 1e-9
    near = (F.least(F.length("a"), F.length("b")) + slack >= F.greatest(F.length("a"), F.length("b")) * span)
    if rate <= 0:  # no bound on bigrams
        return n.crossJoin(c).where(near)
    items = cut(n.select("a").union(c.select(F.col("b").alias("a"))).distinct().select("a", _bigrams(F.col("a")).alias("all")))
    spread = items.select("a", F.explode("all").alias("g"))
    ordered = spread.join(spread.groupBy("g").agg(F.count("*").alias("f")), "g").groupBy("a").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "g"))), lambda x: x["g"]).alias("grams"))
    length = F.length("a")
    least = F.ceil(rate * (length + F.ceil(length * span - slack)) - 1 - slack)  # with the shortest name that may match
    head = F.slice("grams", F.lit(1), F.least(F.size("grams"), F.size("grams") - least + 1).cast("int"))
    empty = F.array().cast("array<string>")
    made = cut(items.select("a").join(ordered, "a", "left").select("a", F.coalesce("grams", empty).alias("grams"), (least <= 0).alias("short"), F.coalesce(head, empty).alias("head")))
    left = n.join(made, "a")
    right = c.join(made.select(F.col("a").alias("b"), F.col("grams").alias("grams_b"), F.col("short").alias("short_b"), F.col("head").alias("head_b")), "b")
    met = left.withColumn("k", F.explode("head")).join(right.withColumn("k", F.explode("head_b")), "k")
    shared = F.size(F.array_intersect("grams", "grams_b")) + slack >= rate * (F.length("a") + F.length("b")) - 1
    by_gram = met.where(near & (F.get(F.array_intersect("head", "head_b"), F.lit(0)) == F.col("k")) & shared)
    by_length = left.where("short").join(right.where("short_b"), near & (F.size(F.array_intersect("head", "head_b")) == 0))
    return by_gram.select("name", "a", "candidate", "b").union(by_length.select("name", "a", "candidate", "b"))


def _one_letter_pairs(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name, a, candidate, b) where a and b are equal or one is the other without one letter: an equi-join, as each has few such forms."""
    shorter = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    forms = lambda f, t: f.where(F.length(t) > 0).withColumn("k", F.explode(F.array_distinct(shorter(F.col(t)))))
    columns = ["name", "a", "candidate", "b"]
    less = forms(names, "a").unionByName(names.withColumn("k", F.col("a"))).join(candidates.withColumn("k", F.col("b")), "k")
    more = names.withColumn("k", F.col("a")).join(forms(candidates, "b"), "k")
    return less.select(columns).union(more.select(columns))


def best_match(names: DataFrame, candidates: DataFrame, floor: float = REVIEW) -> DataFrame:
    """(name, candidate, ratio): the most similar candidate at or above ``floor``; equal ones by candidate.

    Candidates that differ by one letter more or less are met first: any other one has a ratio of n / (n + 1) at most, of n
    letters of the name, and names with a higher one are done. All others are compared with every candidate that can reach
    0.95, those without one then 0.9, and so on down to the floor, in Arrow batches.
    """
    plain = lambda f, as_: cut(f.select(F.col("name").alias(as_[0])).where(f"{as_[0]} IS NOT NULL").distinct().withColumn(as_[1], strip_accents(as_[0])))
    left, c = plain(names, ("name", "a")), plain(candidates, ("candidate", "b"))

    def best(pairs: DataFrame, least: float) -> DataFrame:
        scored = pairs.repartition("name", "candidate").select("name", "candidate", F.length("a").alias("n"), sequence_ratio("a", "b").alias("ratio")).where(F.col("ratio") >= least)  # few rows make many pairs
        order = Window.partitionBy("name").orderBy(F.col("ratio").desc(), "candidate")
        return scored.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")

    found = [cut(best(_one_letter_pairs(left, c), floor).where(F.col("ratio") > F.col("n") / (F.col("n") + 1)))]
    for least in (*(x for x in STAGES if x > floor), floor):
        left = cut(left.join(found[-1].select("name"), "name", "left_anti"))
        if left.isEmpty():
            break
        found.append(cut(best(similar_pairs(left, candidates, least), least)))
    return reduce(DataFrame.union, found).select("name", "candidate", "ratio")


def normalise(names: DataFrame, registry: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, entity, how): exact, alias, merged (ratio of 0.95), review (0.85) or new."""
    n = names.select("name", F.lower(F.trim("name")).alias("k")).distinct()
    exact = registry.select(F.lower("name").alias("k"), F.col("name").alias("exact")).dropDuplicates(["k"])
    alias = aliases.select(F.lower("alias").alias("k"), F.col("entity").alias("by_alias")).dropDuplicates(["k"])
    staged = n.join(exact, "k", "left").join(alias, "k", "left")
    fuzzy = best_match(staged.where("exact IS NULL AND by_alias IS NULL").select("name"), registry)
    joined = staged.join(fuzzy, "name", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_alias").isNotNull(), "alias").when(F.col("ratio") >= MERGE, "merged").when(F.col("ratio").isNotNull(), "review").otherwise("new")
    entity = F.coalesce("exact", "by_alias", F.when(F.col("ratio") >= MERGE, F.col("candidate")), "name")
    return joined.select("name", entity.alias("entity"), how.alias("how"), "candidate", "ratio")


def _alias_score(a: str, b: str) -> float:
    x, y = a.lower(), b.lower()
    tx, ty = set(x.split()), set(y.split())
    overlap = len(tx & ty) / len(tx | ty) if tx | ty else 1.0
    inside = 0.9 if min(len(x), len(y)) >= 3 and (x in y or y in x) else 0.0
    return max(SequenceMatcher(None, x, y).ratio(), overlap, inside)


def resolve_aliases(names: DataFrame, group: str) -> DataFrame:
    """(group, name, canonical, how) of distinct names, in the order of first position: alias, review or canonical.

    Order matters, so a group's distinct names are one task's; a group is one person's category, not a corpus.
    """
    kind = names.schema[group].dataType.simpleString()
    distinct = names.groupBy(group, "name").agg(F.min("position").alias("position"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        canon, out = [], []
        for key, name in rows.sort_values(["position", "name"])[[group, "name"]].itertuples(index=False):
            score, best = max(((_alias_score(name, c), c) for c in canon), key=lambda x: x[0], default=(0.0, None))
            how = "alias" if score >= REVIEW else "review" if score >= ALIAS_REVIEW else "canonical"
            if how == "canonical":
                canon.append(name)
            out.append((key, name, best if how != "canonical" else name, how))
        return pd.DataFrame(out, columns=[group, "name", "canonical", "how"])

    return distinct.groupBy(group).applyInPandas(run, f"{group} {kind}, name string, canonical string, how string")


def detect_roles(texts: DataFrame, patterns: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, role, kind, hits) by a table of patterns (role, kind, pattern, weight): the table is small and met by every text."""
    met = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("t")).crossJoin(F.broadcast(patterns))
    counted = met.select("id", "role", "kind", "weight", F.regexp_count("t", F.col("pattern")).alias("n")).where("n > 0")
    return counted.groupBy("id", "role", "kind").agg(F.sum("n").alias("hits"), F.round(F.sum(F.col("n") * F.col("weight")), 2).alias("score"))


def role_status(score: Column, sources: Column, before: Column) -> Column:
    """Active from a score of 10 over two sources, tracking from 5; an active role stays active."""
    return F.when((before == "active") | ((score >= STATUS_ACTIVE) & (sources >= 2)), "active").when(score >= STATUS_TRACKING, "tracking").otherwise("emergent")


def person_trigger(sources: Column, mentions: Column) -> Column:
    return F.when((sources >= 2) & (mentions >= 30), "create").when((sources >= 1) | (mentions >= 5), "candidate").otherwise("none")


def best_segment(insights: DataFrame, segments: DataFrame, key: str, floor: float = 0.15) -> DataFrame:
    """For each insight (key, id, text) the segment (key, pos, text) of its source with most word overlap above ``floor``.

    Words meet in an equi-join, so only segments that share a word are scored.
    """
    iw = insights.select(key, "id", F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    sw = segments.select(key, "pos", F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    left = iw.select(key, "id", F.size("w").alias("ni"), F.explode("w").alias("t"))
    right = sw.select(key, "pos", F.size("w").alias("ns"), F.explode("w").alias("t"))
    common = left.join(right, [key, "t"]).groupBy(key, "id", "pos", "ni", "ns").agg(F.count("*").alias("c"))
    scored = common.select(key, "id", "pos", (F.col("c") / (F.col("ni") + F.col("ns") - F.col("c"))).alias("score")).where(F.col("score") > floor)
    best = scored.groupBy(key, "id").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("pos")).alias("p"))).alias("b"))
    return best.select(key, "id", (-F.col("b.p")).alias("pos"), F.col("b.score").alias("score"))


def title_key(name: Column) -> Column:
    return F.regexp_replace(strip_accents(name), r"[^a-z0-9]+", " ")
