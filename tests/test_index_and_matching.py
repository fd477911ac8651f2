"""The vector index, matching in rounds, and the bucket store, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from lodegraph.operators import lookups, matching, retrieval, vector_index
from lodegraph.sources import readers, writers
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").cache()


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def share_looked_at(index, asked):
    pairs = vector_index._near_lists(index, asked).where(F.col("near") <= index.probes).join(index.lists, "list").agg(F.sum("size")).first()[0]
    return pairs / index.rows.count() / asked.count()


def test_index_holds_every_vector_once_and_finds_nearly_all(spark, vectors, asked):
    index = vector_index.build(vectors, recall=vector_index.RECALL)
    assert index.rows.count() == index.rows.select("id").distinct().count() == vectors.count()
    scan = {(r["query_id"], r["id"]) for r in retrieval.vector_topk(vectors, asked, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in vector_index.search(index, asked, 10).collect()}
    assert len(scan & found) >= 0.95 * len(scan)
    assert share_looked_at(index, asked) < 0.75  # these vectors are noise


def test_few_lists_do_where_vectors_cluster(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=16) * 0.15 + np.eye(16)[i % 16] + np.eye(16)[i // 16 % 16]).tolist()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").cache()
    asked = frame.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = vector_index.build(frame, recall=vector_index.RECALL)
    scan = {(r["query_id"], r["id"]) for r in retrieval.vector_topk(frame, asked, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in vector_index.search(index, asked, 10).collect()}
    assert len(scan & found) >= 0.95 * len(scan) and share_looked_at(index, asked) < 0.2


@pytest.mark.parametrize("n_lists", [1, 7, None])
def test_exact_search_equals_the_scan(spark, vectors, asked, n_lists):
    index = vector_index.build(vectors, n_lists, sample_rows=300)
    shown = lambda f: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 8)) for r in f.collect())
    assert shown(vector_index.search_exact(index, asked, 12, probes=2)) == shown(retrieval.vector_topk(vectors, asked, 12))


def test_index_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [1.0, 2.0, 3.0]), (6, [0.5, 0.5]), (6, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, vector array<double>")
    got = [(r["query_id"], r["id"], r["rank"]) for r in vector_index.search_exact(vector_index.build(frame), queries, 10).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 4, 2), (1, 6, 3), (1, 6, 4)]
    empty = vector_index.build(frame.limit(0))
    assert vector_index.search(empty, queries).count() == vector_index.search_exact(empty, queries).count() == 0


def greedy(rows, by_left):
    best = {}
    for g, a, b, s in rows:
        if a is not None and b is not None and s is not None:
            best[g, a, b] = max(s, best.get((g, a, b), s))
    out, used = [], set()
    for (g, a, b), s in sorted(best.items(), key=lambda x: ((x[0][1], -x[1], x[0][2]) if by_left else (-x[1], x[0][1], x[0][2]))):
        if (g, 0, a) not in used and (g, 1, b) not in used:
            used |= {(g, 0, a), (g, 1, b)}
            out.append((g, a, b, s))
    return sorted(out, key=str)


@pytest.mark.parametrize("by_left", [False, True])
@pytest.mark.parametrize("last", [0, 40, 10_000])
def test_matching_in_rounds_equals_one_by_one(spark, by_left, last):
    rng = random.Random(3)
    rows = [(rng.choice(["g", "h", None]), f"l{rng.randrange(20)}", f"r{rng.randrange(20)}", rng.randrange(5) / 4) for _ in range(400)]
    rows += [("g", None, "r1", 9.0), ("g", "l1", None, 9.0), ("h", "l1", "r1", None)]
    frame = spark.createDataFrame(rows, "g string, left string, right string, score double")
    got = sorted((tuple(r)[:4] for r in matching.greedy_one_to_one(frame, "g", by_left, last).collect()), key=str)
    assert got == greedy(rows, by_left)


def test_one_group_of_a_hundred_thousand_pairs(spark):
    pairs = spark.range(100_000).select(F.lit("g").alias("g"), F.pmod(F.xxhash64("id"), F.lit(4000)).cast("string").alias("left"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4000)).cast("string").alias("right"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(50)) / 50).alias("score"))
    rows = [tuple(r) for r in pairs.collect()]
    assert sorted((tuple(r)[:4] for r in matching.greedy_one_to_one(pairs, "g").collect()), key=str) == greedy(rows, False)


def merged(rows):
    kept = []
    for owner, name, steps in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        own = {s.lower()[:30] for s in steps}
        if not any(o == owner and (n.lower() == name.lower() or len(own & {s.lower()[:30] for s in st}) >= 3) for o, n, st in kept):
            kept.append((owner, name, steps))
    return sorted(kept, key=str)


def test_frameworks_are_kept_as_one_by_one(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b"]), rng.choice("XyZx") + str(rng.randrange(40)), [f"Step {rng.randrange(12)}" for _ in range(rng.randrange(7))]) for _ in range(150)]
    rows += [(None, "lone", ["p", "q", "r"]), (None, "zone", ["P", "Q", "R", "s"])]
    got = [tuple(r) for r in matching.merge_frameworks(spark.createDataFrame(rows, "owner string, name string, steps array<string>")).collect()]
    assert sorted(got, key=str) == merged(rows)
    assert matching.merge_frameworks(spark.createDataFrame([], "owner string, name string, steps array<string>")).count() == 0


def test_a_bucket_is_changed_alone(spark, tmp_path):
    rows = spark.createDataFrame([(i, "abc"[i % 3], i * 1.0) for i in range(30)] + [(99, None, 1.0)], "id long, bucket string, v double")
    store = writers.BucketStore(spark, str(tmp_path / "t"))
    assert store.read() is None
    store.upsert(rows, ["id"])
    before = store.state()[1]
    store.upsert(spark.createDataFrame([(3, "a", -1.0), (300, "a", 5.0)], rows.schema), ["id"])
    after = store.state()[1]
    assert before["a"] != after["a"] and {k: v for k, v in before.items() if k != "a"} == {k: v for k, v in after.items() if k != "a"}
    assert sorted(r["id"] for r in store.read("a").collect()) == [*range(0, 30, 3), 300]
    assert all("part=" in f and after["a"] in f for f in store.read("a").inputFiles())
    store.clear("b")
    assert sorted({r["bucket"] for r in store.read().collect()}) == ["", "a", "c"]
    store.delete(spark.createDataFrame([(2, "c"), (300, "c"), (1, "none")], "id long, bucket string"), ["id"])
    assert store.read().count() == 11 + 9 + 1 and store.read("b") is None


def test_writers_that_meet_lose_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "id long, bucket string, v double")
    store = writers.BucketStore(spark, str(tmp_path / "t"))
    store.upsert(rows, ["id"])
    base = store.state()[1]
    writers.BucketStore(spark, str(tmp_path / "t")).clear("a")
    store._commit(base, {"b": None})  # another bucket than the other writer's
    with pytest.raises(writers.ConcurrentChange):
        store._commit(base, {"a": base["a"]})
    assert store.read() is None
    store.upsert(rows, ["id"], batch=("s", 4))
    store.upsert(rows.withColumn("v", F.lit(9.0)), ["id"], batch=("s", 4))
    assert [r["v"] for r in store.read().collect()] == [1.0, 1.0]


def test_traces_are_read_as_they_were_written(spark, tmp_path):
    events = spark.sql("SELECT id AS event_id, timestamp'2026-01-30 23:00:00' + make_dt_interval(0, id) AS ts FROM range(60)")
    lookups.append_traces(events, str(tmp_path / "traces"))
    got = readers.traces(spark, str(tmp_path / "traces"), "event_id long", "2026-01-31", "2026-02-01")
    assert sorted(r["event_id"] for r in got.collect()) == list(range(1, 49))
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().executedPlan().toString()


def test_pushed_filter_reaches_the_scan(spark):
    frame = retrieval.pushed(spark.read.parquet(f"{SF}/documents.parquet"), lang="en", source="src0")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "EqualTo(source,src0)" in plan
    assert retrieval.pushed(spark.createDataFrame([("EN",)], "lang string"), lang="en").count() == 0


def test_first_source_of_a_path_wins(spark, tmp_path):
    (tmp_path / "x.md").write_text("x")
    (tmp_path / "y.md").write_text("y")
    found = readers.corpus(spark, [readers.Source("one", f"{tmp_path}/x.md", "p"), readers.Source("two", f"{tmp_path}/*.md", "q")]).collect()
    assert sorted((r["path"][-4:], r["source"], r["bucket"]) for r in found) == [("x.md", "one", "p"), ("y.md", "two", "q")]


def test_rare_values_have_full_results(spark):
    from lodegraph.operators import search

    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    asked = read("benchmark").join(read("embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").alias("vector")).where("query_id < 8")
    docs = read("documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")
    got = search.hybrid_search(docs, read("embeddings").select(F.col("vec_id").alias("id"), "embedding"), asked, source="src7").join(docs, "id").groupBy("query_id").agg(F.count("*").alias("n"), F.min("source").alias("s"), F.max("source").alias("t")).collect()
    assert len(got) == asked.count() and all(r["n"] == 10 and r["s"] == r["t"] == "src7" for r in got)
