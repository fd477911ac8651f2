"""Retrieval and grounding metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import text as T


def retrieval_metrics(results: DataFrame, relevant: DataFrame, k: int, total: DataFrame | None = None) -> DataFrame:
    """recall@k, nDCG@k and first relevant rank of each query: results (query_id, id, rank), relevant (query_id, id).

    With ``total`` (query_id, n_relevant), ``relevant`` need only have the pairs that are in the results.
    """
    rel = relevant.select("query_id", "id").distinct()
    total = rel.groupBy("query_id").agg(F.count("*").alias("n_relevant")) if total is None else total
    hits = results.where(F.col("rank") <= k).join(rel, ["query_id", "id"])
    found = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.min("rank").alias("first_hit"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    joined = total.join(found, "query_id", "left")
    return joined.select("query_id", "n_relevant", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(F.coalesce(F.col("hits") / F.col("n_relevant"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"), "first_hit")


def relevant_by_class(results: DataFrame, queries: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of queries (query_id, label) and items (id, label) that are relevant where labels are equal: the pairs (query_id, id) among the results, and
    (query_id, n_relevant) of all. All pairs would be the square of a class.
    """
    met = results.select("query_id", "id").distinct().join(queries.distinct(), "query_id").join(items.distinct(), ["id", "label"])
    sizes = items.groupBy("label").agg(F.count_distinct("id").alias("n"))
    return met.select("query_id", "id"), queries.distinct().join(sizes, "label").groupBy("query_id").agg(F.sum("n").alias("n_relevant"))


def id_precision(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Share of retrieved ids that were expected, per query."""
    marked = results.join(expected.select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    return marked.groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("precision"))


def claims(text: Column, least_chars: int = 20) -> Column:
    """Sentences that can be checked: long enough and no questions."""
    return F.filter(T.sentences(text), lambda s: (F.length(s) >= least_chars) & ~s.endswith("?"))


def support(claim: Column, context: Column, least: int = 4) -> Column:
    """Share of the claim's longer tokens that the context has; 1 without any."""
    key = F.array_distinct(F.filter(T.tokens(claim), lambda t: F.length(t) >= least))
    return F.when(F.size(key) == 0, 1.0).otherwise(F.size(F.array_intersect(key, T.tokens(context))) / F.size(key))


def grounded_ratio(outputs: DataFrame, agent: str, text_col: str, context_col: str, floor: float = 0.5) -> DataFrame:
    """Share of each agent's claims that its context supports, with a total."""
    rows = outputs.select(F.col(agent).alias("agent"), F.col(context_col).alias("context"), F.explode(claims(F.col(text_col))).alias("claim"))
    scored = rows.select("agent", (support(F.col("claim"), F.col("context")) >= floor).cast("int").alias("ok"))
    return scored.rollup("agent").agg(F.count("*").alias("n_claims"), F.round(F.avg("ok"), 4).alias("ratio"))


def breaches(metrics: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Means below their floors."""
    means = metrics.agg(*(F.avg(m).alias(m) for m in floors))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(f).alias("floor")) for m, f in floors.items()))
    return means.select(F.inline(rows)).where("value < floor OR value IS NULL")
