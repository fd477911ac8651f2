"""Walks of many questions at once against the walk of each."""

from __future__ import annotations

import random

import pytest
from lodegraph.operators import graph, knowledge
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def web(spark):
    rng = random.Random(2)
    nodes = [(f"n{i}", ["concept", "domain", "agent"][i % 7 // 3 if i % 7 < 6 else 0], f"Word{i % 9} label{i % 5}", "Ana" if i % 2 else "Bo") for i in range(60)]
    edges = [(f"n{rng.randrange(50)}", f"n{rng.randrange(50)}", rng.choice([1.0, 2.0, 0.5])) for _ in range(140)] + [("n0", f"n{i}", 1.0) for i in range(1, 40)]
    edges = [e for e in edges if e[0] != e[1]]
    return spark.createDataFrame(nodes, "id string, type string, label string, person string").cache(), spark.createDataFrame(edges, "source string, target string, weight double").cache()


def test_each_question_is_within_epsilon_of_its_walk(spark, web):
    nodes, edges = web
    seeds = [(1, "n3", 2.0), (1, "n7", 1.0), (2, "n55", 1.0), (3, "n0", 0.5), (3, "n0", 0.5), (4, "nowhere", 1.0), (5, "n9", 0.0)]
    got = graph.batched_pagerank(nodes, edges, spark.createDataFrame(seeds, "query_id long, id string, mass double"), epsilon=0.03).collect()
    assert {r["query_id"] for r in got} == {1, 2, 3}
    for q in (1, 2, 3):
        own = spark.createDataFrame([(i, m) for k, i, m in seeds if k == q], "id string, mass double").groupBy("id").agg(F.sum("mass").alias("mass"))
        want = {r["id"]: r["score"] for r in graph.personalised_pagerank(nodes, edges, own, rounds=30, tolerance=1e-3, every=2).collect()}
        mine = {r["id"]: r["score"] for r in got if r["query_id"] == q}
        assert all(-1e-2 <= want[i] - mine.get(i, 0.0) <= 0.03 for i in want)
        assert 0.97 <= sum(mine.values()) <= 1 + 1e-9


def test_two_hundred_questions(spark, web):
    nodes, edges = web
    questions = spark.createDataFrame([(i, f"what of word{i % 9} and label{i % 5}?") for i in range(200)], "query_id long, query string")
    got = knowledge.associative_many(questions, nodes, edges, k=5, epsilon=0.1).collect()
    assert {r["query_id"] for r in got} == set(range(200)) and max(r["rank"] for r in got) <= 5
    kinds = {r["id"]: (r["type"], r["person"]) for r in nodes.collect()}
    assert all(kinds[r["id"]][0] == "concept" for r in got)
    few = knowledge.associative_many(questions.where("query_id < 3"), nodes, edges, exclude_seeds=True, epsilon=0.2).collect()
    assert not any(r["is_seed"] for r in few)
    anas = knowledge.associative_many(questions.where("query_id < 3"), nodes, edges, person="ana", epsilon=0.2).collect()
    assert anas and all(kinds[r["id"]][1] == "Ana" for r in anas)
    one = {r["id"]: r["mass"] for r in knowledge.seeds(nodes, "what of word1 and label1?").collect()}
    assert {r["id"]: r["mass"] for r in knowledge.seeds_of(nodes, questions.where("query_id = 1")).collect()} == pytest.approx(one)
