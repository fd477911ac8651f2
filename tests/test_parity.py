"""Results written by hand from the definitions, apart from the queries' own SQL."""

from __future__ import annotations

import hashlib

import numpy as np
from lodegraph.operators import dedup, graph, rules, semantic
from pyspark.sql import functions as F


def test_pipelines_of_intents(spark):
    want = {"greeting": "none", "meta": "none", "factual_simple": "bm25", "factual_complex": "hybrid", "analytical": "hybrid_graph", "cross_expert": "hybrid_graph", "hierarchical": "full"}
    frame = spark.createDataFrame([(k,) for k in want], "i string")
    assert {r["i"]: r["p"] for r in frame.select("i", rules.pipeline_of(F.col("i")).alias("p")).collect()} == want


def test_pagerank_goes_by_weight(spark):
    nodes = spark.createDataFrame([(x,) for x in "abc"], "id string")
    edges = spark.createDataFrame([("a", "b", "r", 3.0), ("a", "c", "r", 1.0)], "source string, target string, rel string, weight double")
    seeds = spark.createDataFrame([("a", 2.0), ("nowhere", 5.0)], "id string, mass double")
    got = {r["id"]: r["score"] for r in graph.personalised_pagerank(nodes, edges, seeds, rounds=1, alpha=0.2).collect()}
    assert np.allclose([got[x] for x in "abc"], [0.2, 0.6, 0.2])
    assert graph.personalised_pagerank(nodes, edges, seeds.where("mass > 9"), rounds=1).count() == 0


def test_near_words(spark):
    text = "Title: a call\nDate: 2026-05-27\n=====\n  Hello [MEET-12] World at 09:54 gmt-3, ÉTÉ 3x \r\nsource of truth\nDuration\nthe end"
    (got,) = spark.createDataFrame([(text,)], "t string").select(dedup.near_words(F.col("t"))).first()
    assert got == ["hello", "world", "at", "été", "x", "the", "end"]


def test_simhash_counts_every_shingle(spark):
    words = ("alpha beta gamma delta " * 20).split() + [f"w{chr(97 + i)}" for i in range(10)]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    votes = [0] * 64
    for g in grams:
        h = int.from_bytes(hashlib.md5(g.encode()).digest()[:8], "big")
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    want = sum(1 << b for b in range(64) if votes[b] > 0)
    (got,) = dedup.simhash(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).select("simhash").first()
    assert got & (2**64 - 1) == want


def test_boundaries_cut_before_the_minimum_itself():
    """A dip at place 4 is a minimum of the smoothed curve there, and the lowest fifth is what lies below the second lowest value."""
    likeness = [0.9, 0.91, 0.92, 0.6, 0.1, 0.6, 0.92, 0.9, 0.91, 0.92]
    assert semantic.boundaries(likeness) == [4]
    assert semantic.boundaries([0.9, 0.2, 0.8]) == [] and semantic.boundaries([]) == []
    assert semantic.thinned([1, 2, 4, 5]) == [1, 4]


def test_short_groups_stay():
    class Turns:
        def embed(self, texts):
            return [[1.0, 0.0] if i < 4 else [0.0, 1.0] for i in range(len(texts))]

    text = " ".join(f"Line {i}." for i in range(14))
    assert " ".join(semantic.semantic_split(text, Turns())) == text


def test_results_lose_duplicates_in_four_layers(spark):
    from lodegraph.operators import search

    body = "the same words again and again " * 12
    rows = [
        (1, 1, "a", body, "f", 1), (1, 2, "a", "other", "g", 1), (1, 3, "b", "third", "f", 1), (1, 4, "c", body, "h", 9), (1, 5, "d", body[:-3] + "x", "h", 10),
        (1, 6, "e", "quite another text", "h", 11), (2, 1, "d", body, "f", 1), (1, 7, "g", "", "", None), (1, 8, "h", "", "", None),
    ]
    frame = spark.createDataFrame(rows, "query_id long, rank int, id string, text string, source string, offset long")
    assert sorted((r["query_id"], r["id"]) for r in search.deduplicated(frame).collect()) == [(1, "a"), (1, "e"), (1, "g"), (1, "h"), (2, "d")]
