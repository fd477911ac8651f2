"""The composed search: both arms, fusion, filter, deduplication of ranked results, reranking and order."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.operators import retrieval

#: Results of a query that are compared with one another, and characters of each.
POOL, HEAD_CHARS = 50, 500
LIKENESS = 0.95
TOP = 10


def _first(rows: DataFrame, keys: list[str], usable) -> DataFrame:
    """Rows without a usable key, and the best ranked one of each key."""
    place = F.row_number().over(Window.partitionBy("query_id", *keys).orderBy("rank", "id"))
    return rows.where(~usable).unionByName(rows.where(usable).withColumn("_place", place).where("_place = 1").drop("_place"))


def deduplicated(results: DataFrame, likeness: float = LIKENESS, most: int | None = POOL) -> DataFrame:
    """Ranked results (query_id, rank, id, text, source, offset) less their duplicates, in four layers.

    The same id, the same place of a source, the same text, and a text whose first characters are alike to those of a better
    one by more than ``likeness``. The last layer looks at the ``most`` best of a query, so its groups have a bound; with a
    likeness of 1 it is left out.
    """
    rows = _first(results, ["id"], F.coalesce(F.col("id").cast("string"), F.lit("")) != "")
    rows = _first(rows, ["source", "offset"], (F.coalesce("source", F.lit("")) != "") & F.col("offset").isNotNull())
    rows = rows.withColumn("_hash", T.content_sha(F.coalesce("text", F.lit(""))))
    rows = _first(rows, ["_hash"], F.coalesce("text", F.lit("")) != "").drop("_hash")
    if likeness >= 1:
        return rows
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))
    head = rows.withColumn("_at", place).where(F.col("_at") <= most).select("query_id", "id", "_at", F.substring(F.coalesce("text", F.lit("")), 1, HEAD_CHARS).alias("head"))

    def alike(text: str, kept: SequenceMatcher) -> bool:
        kept.set_seq1(text)
        return kept.real_quick_ratio() > likeness and kept.quick_ratio() > likeness and kept.ratio() > likeness  # bounds first

    def distinct(group: pd.DataFrame) -> pd.DataFrame:
        kept, ids = [], []
        for row in group.sort_values("_at").itertuples():
            if row.head and any(alike(row.head, k) for k in kept):
                continue
            kept += [SequenceMatcher(None, "", row.head)] * bool(row.head)
            ids.append(row.id)
        return pd.DataFrame({"query_id": [group["query_id"].iloc[0]] * len(ids), "id": ids})

    types = dict(results.dtypes)
    found = head.groupBy("query_id").applyInPandas(distinct, f"query_id {types['query_id']}, id {types['id']}")
    return rows.join(found, ["query_id", "id"], "left_semi")


def hybrid_search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = TOP, strategic: bool = True, **wanted: str | None) -> DataFrame:
    """(query_id, id, score, place): the best k documents (id, text, source, ..) of each query (query_id, query, vector).

    Documents are filtered by ``wanted`` before anything else, so a rare value has as many results as a common one, and
    statistics are those of the filtered documents. Words and vectors each bring their best; ranks are fused and cleared of
    duplicates, scores are blended with the cosines, and the best stand at both ends if ``strategic``.
    """
    docs = retrieval.filtered(docs, **wanted)
    if any(wanted.values()):
        vectors = vectors.join(docs.select("id"), "id", "left_semi")
    words = retrieval.bm25(docs, queries, id_col="id")
    near = retrieval.vector_topk(vectors, queries, id_col="id")
    fused = retrieval.rrf(words, near).join(docs.select(F.col("id"), "text", *[c for c in docs.columns if c not in ("id", "text")]), "id")
    pool = retrieval.ranked(fused, "query_id", POOL)
    if "offset" not in pool.columns:
        pool = pool.withColumn("offset", F.lit(None).cast("long"))
    kept = deduplicated(pool.select("query_id", "rank", "id", "text", "source", "offset", "score"))
    blended = retrieval.rescored(kept.select("query_id", "id", "score"), retrieval.cosines(kept, vectors, queries, id_col="id"))
    best = retrieval.ranked(blended.select("query_id", "id", F.col("blended").alias("score")), "query_id", k)
    n = F.count("*").over(Window.partitionBy("query_id"))
    place = retrieval.strategic_position(F.col("rank"), n) if strategic else F.col("rank").cast("long")
    return best.withColumn("place", place).select("query_id", "id", "score", "place")
