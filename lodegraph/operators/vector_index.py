"""An inverted-file index for vector search.

Vectors are brought to length one and put into the list of the nearest of some centroids. Centroids are fitted by spherical
k-means to a bounded sample (``SAMPLE_ROWS`` rows with the smallest hashes of id and vector); every vector is put into a list,
and none is left out of the index. A list knows the largest angle between its centroid and its vectors, so that the best
cosine which a query can find in it has a bound.

``search`` looks into the lists nearest to each query, as many as bring the share ``RECALL`` of the best vectors of some rows
of the index that are asked as queries when it is built: few where vectors cluster, about half of all where they are noise.
``search_exact`` then looks into all lists whose bound exceeds the
k-th score that was found, so its result is that of a scan of all vectors, whatever the data; how many lists that are
depends on how well the vectors cluster.

Defined results: null vectors, and those of another length than the first one's, are left out; zero vectors have the score 0
and are found no more than by the scan; of equal scores the smaller id comes first; an empty table has an empty index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.operators import vector_scan
from lodegraph.operators.retrieval import POOL, ranked
from lodegraph.session import cut

#: Bound on the vectors that centroids are fitted to, and on the number of centroids.
SAMPLE_ROWS, MOST_LISTS = 20_000, 4096
ROUNDS = 12
#: Lists that the exact way begins with.
PROBES = 8
#: Share of the best vectors that the nearest lists should bring, and the rows of the index that it is measured with.
RECALL, MEASURED = 0.97, 64
#: Angles are kept with this slack, so that rounding never hides a vector.
SLACK = 1e-6


def units(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def nearest(rows: np.ndarray, centroids: np.ndarray, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its cosine, ``step`` rows at a time."""
    own, cosine = np.zeros(len(rows), int), np.zeros(len(rows))
    for i in range(0, len(rows), step):
        scores = rows[i : i + step] @ centroids.T
        own[i : i + step], cosine[i : i + step] = scores.argmax(1), scores.max(1)
    return own, cosine


def fit_centroids(sample: np.ndarray, n_lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of a sample of unit vectors; an empty list takes the vector that is farthest from its own centroid."""
    if not len(sample):
        return sample
    picks = np.random.default_rng(seed).choice(len(sample), min(n_lists, len(sample)), replace=False)
    centroids = sample[picks]
    for _ in range(rounds):
        own, cosine = nearest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centroids)) == 0)
        sums[empty] = sample[np.argsort(cosine, kind="stable")[: len(empty)]]
        centroids = units(sums)
    return centroids


@dataclass(frozen=True)
class VectorIndex:
    """``rows``: list, id and unit vector; ``lists``: list, its largest angle and its number of vectors; the centroids; the lists to look into."""

    rows: DataFrame
    lists: DataFrame
    centroids: np.ndarray
    probes: int = PROBES


def build(vectors: DataFrame, n_lists: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, recall: float | None = None) -> VectorIndex:
    """``n_lists``: four times the root of the number of vectors if not given, at most MOST_LISTS; ``recall``: sets the index's probes."""
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    first = given.orderBy("id").first()
    width = len(first["v"]) if first else 0
    given = given.where(F.size("v") == width)
    total = given.count()
    share = min(1.0, 1.1 * sample_rows / max(1, total))
    near = given.where(F.xxhash64(F.lit(5), "id", "v") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63)))
    sample = [r["v"] for r in near.orderBy(F.xxhash64(F.lit(5), "id", "v"), "id").limit(sample_rows).collect()]
    wanted = n_lists or min(MOST_LISTS, max(1, round(4 * total**0.5)))
    centroids = fit_centroids(units(np.array(sample, float).reshape(len(sample), width)), min(wanted, max(1, len(sample) // 4)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, cosine = nearest(units(np.stack(batch["v"].to_list()).astype(float)), centroids) if len(batch) else (np.zeros(0), np.zeros(0))
            yield pd.DataFrame({"list": own.astype("int32"), "angle": np.arccos(np.clip(cosine, -1, 1)), "id": batch["id"], "v": batch["v"]})

    kind = vectors.schema[id_col].dataType.simpleString()
    if not len(centroids):
        rows = given.select(F.lit(0).alias("list"), F.lit(0.0).alias("angle"), "id", "v")
    else:
        rows = given.mapInPandas(assign, f"list int, angle double, id {kind}, v array<double>")
    # Rows of a list lie together, those of a large one in several files.
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    rows = cut(rows.withColumn("a", T.unit(F.col("v"))).drop("v").repartitionByRange(parts, "list", "id").sortWithinPartitions("list"))
    index = VectorIndex(rows.select("list", "id", "a"), rows.groupBy("list").agg(F.max("angle").alias("angle"), F.count("*").alias("size")), centroids)
    return index if recall is None else replace(index, probes=probes_for(index, recall))


def probes_for(index: VectorIndex, recall: float = RECALL, k: int = POOL, measured: int = MEASURED) -> int:
    """Lists that bring ``recall`` of the best k vectors, measured on ``measured`` rows of the index."""
    asked = cut(index.rows.orderBy(F.xxhash64(F.lit(6), "id"), "id").limit(measured).select(F.col("id").alias("query_id"), F.col("a").alias("vector")))
    best = search_exact(index, asked, k).join(index.rows.select("id", "list"), "id").join(_near_lists(index, asked).select("query_id", "list", "near"), ["query_id", "list"])
    places = [r["near"] for r in best.select("near").collect()]  # at most measured * k rows
    return int(np.quantile(places, recall, method="higher")) if places else PROBES


def _near_lists(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """(query_id, list, near): each query's lists by nearness from 1; for a few queries, as there is a row for each list."""
    used = np.array(sorted(r["list"] for r in index.lists.select("list").collect()), dtype=int)  # at most MOST_LISTS rows
    centroids = index.centroids[used] if len(used) else index.centroids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for query_id, b in zip(batch["query_id"], batch["b"]):
                order = np.argsort(-np.clip(centroids @ units(np.array([b], float))[0], -1, 1), kind="stable")
                yield pd.DataFrame({"query_id": query_id, "list": used[order].astype("int32"), "near": np.arange(1, len(used) + 1, dtype="int32")})

    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, list int, near int"
    asked = queries.select("query_id", T.unit(F.col("vector").cast("array<double>")).alias("b")).where("b IS NOT NULL")
    return asked.mapInPandas(run, kind) if len(used) else queries.sparkSession.createDataFrame([], kind)


def _by_list(index: VectorIndex, queries: DataFrame, k: int | None, floor: float, column: str, wanted: Callable[[np.ndarray, float, np.ndarray, np.ndarray], np.ndarray], least: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): each list's vectors meet the queries for which it is ``wanted(cosines of its centroid, its largest angle, column, least scores)``."""
    radius, centroids = {r["list"]: r["angle"] for r in index.lists.collect()}, index.centroids  # at most MOST_LISTS rows

    def work(batch: pa.RecordBatch, asked: vector_scan.Queries, kept: vector_scan.Kept) -> None:
        if not batch.num_rows or centroids.shape[1] not in asked.by_width:
            return
        places, b = asked.by_width[centroids.shape[1]]
        lists, a = batch.column("list").to_numpy(), batch.column("a").flatten().to_numpy().reshape(batch.num_rows, -1)
        begins = np.flatnonzero(np.diff(lists, prepend=-1))
        for begin, end in zip(begins, [*begins[1:], len(lists)]):
            cosines = np.clip(b @ centroids[lists[begin]], -1, 1)
            met = wanted(cosines, radius[lists[begin]], asked.more[column][places], kept.least[places])
            if met.any():
                kept.offer(batch.column("id").slice(begin, end - begin), a[begin:end], *((places, b) if met.all() else (places[met], b[met])))

    return ranked(vector_scan.scores(index.rows, queries, vector_scan.query_blocks(queries, column), k, floor, work, least), "query_id", k)


def search(index: VectorIndex, queries: DataFrame, k: int = POOL, probes: int | None = None, floor: float = 0.0) -> DataFrame:
    """(query_id, id, score, rank) of the best k vectors in the ``probes`` (else the index's) lists that are nearest to each query (query_id, vector), equally near ones included."""
    used = np.array(sorted(r["list"] for r in index.lists.select("list").collect()), dtype=int)  # at most MOST_LISTS rows
    centroids, most = index.centroids[used] if len(used) else index.centroids, min(probes or index.probes, len(used))

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = [v is not None and len(v) == centroids.shape[1] and not any(x is None for x in v) for v in batch["vector"]]
            cosines = [np.partition(units(np.array([v], float))[0] @ centroids.T, len(used) - most)[len(used) - most] if fit else 0.0 for v, fit in zip(batch["vector"], fits)]
            yield batch.assign(reach=cosines)

    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    asked = asked.mapInPandas(reach, f"query_id {queries.schema['query_id'].dataType.simpleString()}, vector array<double>, reach double") if most else asked.withColumn("reach", F.lit(0.0))
    return _by_list(index, asked, k, floor, "reach", lambda cosines, _, reached, __: ~(cosines < reached - SLACK))


def search_exact(index: VectorIndex, queries: DataFrame, k: int = POOL, probes: int = PROBES, floor: float = 0.0) -> DataFrame:
    """The result of a whole scan: all lists are looked into that may hold a vector as good as the k-th of ``search``, or as one found since."""
    first = search(index, queries, k, probes, floor).groupBy("query_id").agg(F.count("*").alias("n"), F.min(F.round("score", 9)).alias("least"))
    reached = F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf")))
    asked = cut(queries.select("query_id", "vector").join(first, "query_id", "left").select("query_id", "vector", F.coalesce(reached, F.lit(float("-inf"))).alias("least")))

    def wanted(cosines: np.ndarray, angle: float, _: np.ndarray, least: np.ndarray) -> np.ndarray:
        bound = np.cos(np.maximum(0.0, np.arccos(cosines) - angle - SLACK)) + SLACK
        return ~(bound < least - 1e-8) & ~(bound <= floor)  # NaN is above all numbers

    return _by_list(index, asked, k, floor, "least", wanted, "least")
