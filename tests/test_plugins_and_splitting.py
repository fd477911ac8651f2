"""Plug-ins with their offline defaults, semantic splitting, transcripts, greedy matching."""

from __future__ import annotations

import numpy as np
import pytest
from lodegraph import plugins
from lodegraph.operators import matching, semantic, transcripts
from pyspark.sql import functions as F


def test_registry_and_hooks():
    assert plugins.EMBEDDERS.names() == ["hashing"] and plugins.EMBEDDERS.make("hashing", size=8).signature == "hashing:8"
    with pytest.raises(KeyError):
        plugins.MODELS.make("none")
    hooks, seen = plugins.Hooks(), []
    hooks.on("x", lambda v: 1 / 0)
    hooks.on("x", lambda v: seen.append(v))
    assert len(hooks.fire("x", v=3)) == 1 and seen == [3]
    assert plugins.cascade({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert plugins.allowed("go", black=["stop"]) and not plugins.allowed("go", white=["stay"]) and not plugins.allowed("go", calls=2, most=2)


def test_embeddings_are_reused(spark):
    chunks = spark.createDataFrame([(1, "some words here"), (2, "other words there"), (3, None)], "id long, text string")
    made = plugins.with_embeddings(chunks, plugins.HashingEmbedder(16))
    assert all(len(r["embedding"]) == 16 for r in made.collect())
    prior = plugins.reused_embeddings(chunks.where("id = 1"), spark.createDataFrame([], "content_sha string, embedding array<double>"), plugins.HashingEmbedder(16), 16)
    again = plugins.reused_embeddings(chunks, prior.select("content_sha", "embedding"), plugins.HashingEmbedder(16), 16)
    assert {r["id"]: r["reused"] for r in again.collect()} == {1: True, 2: False, 3: False}


def test_relevance(spark):
    rows = spark.createDataFrame([("red fox", "a red fox"), ("red fox", "blue"), ("cat", "cat")], "query string, text string")
    assert [r["relevance"] for r in plugins.with_relevance(rows, plugins.OverlapReranker()).collect()] == [1.0, 0.0, 1.0]


def test_semantic_boundaries():
    assert semantic.nearest_rank([1, 2, 3, 4, 5], 0.2) == 2
    assert semantic.thinned([1, 2, 4, 5, 9]) == [1, 4, 9]
    dip = [0.9, 0.9, 0.9, 0.1, 0.9, 0.9, 0.9, 0.9]
    assert semantic.boundaries(dip) and all(2 <= b <= 5 for b in semantic.boundaries(dip))
    assert semantic.boundaries([]) == [] and semantic.grouped(["a", "b", "c"], [2]) == ["a b", "c"]


def test_semantic_split_falls_back():
    class Broken:
        signature = "broken"

        def embed(self, texts):
            raise RuntimeError

    text = " ".join(f"Sentence number {i} has some words in it." for i in range(60))
    assert semantic.semantic_split(text, Broken()) == semantic.split_text(text)
    pieces = semantic.semantic_split(text, plugins.HashingEmbedder())
    assert pieces and all(len(p) >= 100 for p in pieces)
    assert np.allclose(plugins.HashingEmbedder().embed([""]), 0)


def test_transcripts(spark):
    assert transcripts.segments_of("[00:01] Ann: hi there\n[00:05] Bob: yes\nmore") == [("Ann", "00:01", "hi there"), ("Bob", "00:05", "yes\nmore")]
    assert transcripts.segments_of("Ann: hi\nno turns") == []
    assert transcripts.steps_of("1. do this\n2. do that") == ["do this", "do that"]
    assert transcripts.steps_of("First, open it. Then close it.") == ["open it", "close it"]
    frame = spark.createDataFrame([(1, "Title: X\n==========\na\n==========\nb\n==========\nthe body"), (2, "only")], "doc_id long, text string")
    got = {r["doc_id"]: (r["t"], r["b"]) for r in frame.select("doc_id", transcripts.header(F.col("text"), "Title").alias("t"), transcripts.body(F.col("text")).alias("b")).collect()}
    assert got == {1: ("X", "the body"), 2: (None, "only")}
    cited = spark.createDataFrame([(1, "- one [chunk_1]\n- two\n```\n- code\n```\ntext")], "doc_id long, text string")
    assert [(r["statements"], r["cited"], r["verdict"]) for r in transcripts.citation_share(cited).collect()] == [(2, 1, "WARN")]


def test_matching(spark):
    scores = spark.createDataFrame([("g", "a", "x", 0.95), ("g", "a", "y", 0.9), ("g", "b", "x", 0.93), ("g", "b", "y", 0.6)], "g string, left string, right string, score double")
    assert {(r["left"], r["right"], r["band"]) for r in matching.greedy_one_to_one(scores, "g").collect()} == {("a", "x", "EXACT"), ("b", "y", "POSSIBLE")}
    memories = spark.createDataFrame([("m", "a b c d e f g", 0.2, 1, ["x"]), ("m", "a b c d e f g h", 0.5, 2, ["y"]), ("m", "z", 0.1, 1, [])], "agent string, content string, importance double, references long, tags array<string>")
    got = {r["content"]: (r["importance"], r["references"], r["tags"]) for r in matching.consolidate(memories).collect()}
    assert got == {"a b c d e f g h": (0.5, 3, ["x", "y"]), "z": (0.1, 1, [])}
    frames = spark.createDataFrame([("o", "A", ["one", "two", "three"]), ("o", "B", ["one", "two", "three", "four"]), ("o", "C", ["five"])], "owner string, name string, steps array<string>")
    assert {r["name"] for r in matching.merge_frameworks(frames).collect()} == {"A", "C"}
