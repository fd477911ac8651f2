"""Operators on hand-sized inputs, readers and sinks on temporary folders, streams against batches."""

from __future__ import annotations

import json

import pytest
from lodegraph.functions import fuzzy
from lodegraph.functions import text as T
from lodegraph.operators import chunking, dedup, entity, graph, plan, retrieval, rules, windows
from lodegraph.sources import readers, writers
from lodegraph.streaming import events as streams
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_strategic_order(spark):
    rows = spark.range(1, 7).select(retrieval.strategic_position(F.col("id"), F.lit(6)).alias("p"), "id").orderBy("p").collect()
    assert [r["id"] for r in rows] == [1, 3, 5, 6, 4, 2]


def test_rrf_of_a_shared_head(spark):
    lists = [spark.createDataFrame([("q", "a", 1), ("q", x, 2)], "query_id string, id string, rank int") for x in "bc"]
    got = {r["id"]: r["score"] for r in retrieval.rrf(*lists).collect()}
    assert got["a"] == pytest.approx(2 / 61) and got["b"] == got["c"] == pytest.approx(1 / 62)


def test_canonical_hash_ignores_marks_and_line_ends(spark):
    found = {value(spark, T.canonical_hash(F.lit(t))) for t in ("hello\n", "hello\r\n", "﻿hello\n")}
    assert len(found) == 1 and found.pop().startswith("5891b5b5")


def test_scalar_functions(spark):
    assert [value(spark, T.effort_band(F.lit(x).cast("double"))) for x in (0.5, 1.5, 5, 20, 45, 90, 0)] == [1, 2, 3, 4, 5, 6, 3]
    assert value(spark, T.amount(F.lit("$1.5M"))) == 1_500_000 and value(spark, T.amount(F.lit("2,500"))) == 2500
    assert value(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1
    assert value(spark, T.youtube_id(F.lit("https://youtu.be/abcdefghijk?t=1"))) == "abcdefghijk"
    assert value(spark, T.epoch_text(F.lit(1_700_000_000_000).cast("double"))) == value(spark, T.epoch_text(F.lit(1_700_000_000).cast("double"))) == "2023-11-14 22:13"
    assert value(spark, T.gauge(F.lit(2))) == "##..." and value(spark, T.parse_vector(F.lit("[1, 2.5]"))) == [1.0, 2.5]
    assert value(spark, T.json_metadata(F.lit("no json"))) == {} and value(spark, T.word_delta(F.lit("a b c d"), 2)) == "c d"
    assert value(spark, T.sentences(F.lit("One. Two! Three"))) == ["One.", "Two!", "Three"]
    assert value(spark, fuzzy.strip_accents(F.lit("Éa"))) == "ea" and value(spark, fuzzy.sequence_ratio(F.lit("abcd"), F.lit("abcd"))) == 1


def test_thinning(spark):
    assert value(spark, windows.thinned(F.array(*map(F.lit, (1, 2, 3, 5, 6))), 2)) == [1, 3, 5]


def test_recursive_split():
    words = " ".join(f"w{i}" for i in range(900))
    pieces = chunking.split_text(words)
    assert all(len(p) <= 1650 for p in pieces) and pieces[1].startswith(pieces[0][-150:])
    assert chunking.split_text("short") == [] and chunking.split_text("x" * 120) == ["x" * 120]
    assert chunking.split_text("y" * 4000)[0] == "y" * 1500


def test_simhash_is_near_for_near_texts(spark):
    base = " ".join(f"word{i}" for i in range(300))
    frame = spark.createDataFrame([(1, base), (2, base + " more"), (3, " ".join(f"other{i}" for i in range(300))), (4, "too short")], "doc_id long, text string")
    prints = {r["id"]: r["simhash"] for r in dedup.simhash(frame).collect()}
    assert set(prints) == {1, 2, 3}
    assert bin((prints[1] ^ prints[2]) & (2**64 - 1)).count("1") < bin((prints[1] ^ prints[3]) & (2**64 - 1)).count("1")


def test_plan_of_a_diamond(spark):
    nodes = spark.createDataFrame([("n1", 45.0), ("n2", 90.0), ("n3", 20.0), ("n4", 30.0)], "id string, minutes double")
    edges = spark.createDataFrame([("n1", "n2"), ("n1", "n3"), ("n2", "n4"), ("n3", "n4")], "source string, target string")
    assert {r["id"]: r["level"] for r in plan.levels(nodes, edges).collect()} == {"n1": 0, "n2": 1, "n3": 1, "n4": 2}
    assert [r["minutes"] for r in plan.batches(nodes, edges).orderBy("level").collect()] == [45, 90, 30]
    assert plan.critical_path(nodes, edges).agg(F.max("finish")).first()[0] == 165
    loop = edges.union(spark.createDataFrame([("n4", "n1")], edges.schema))
    with pytest.raises(plan.CycleError):
        plan.levels(nodes, loop)


def test_pagerank_mass_and_hyperedges(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    seeds = spark.createDataFrame([("a", 2.0)], "id string, mass double")
    got = {r["id"]: r["score"] for r in graph.personalised_pagerank(nodes, edges, seeds).collect()}
    assert sum(got.values()) == pytest.approx(1) and got["d"] == 0 and got["b"] > got["c"]
    groups = spark.createDataFrame([(["x", "y"],), (["y", "x"],)], "participants array<string>")
    he, star = graph.hyperedges(groups, "m")
    assert [r["id"] for r in he.collect()] == ["he::m::x|y"] and star.count() == 2


def test_rules(spark):
    ask = lambda q: value(spark, rules.intent(F.lit(q)))
    assert [ask(q) for q in ("Hello there", "what is x?", "compare a and b", "some long words without any rule here")] == ["greeting", "factual_simple", "factual_complex", "analytical"]
    frame = spark.createDataFrame([("p", 1, "isso nunca muda"), ("p", 2, "sempre muda"), ("q", 3, "nunca"), ("q", 4, "nada")], "g string, id long, text string")
    got = rules.contradictions(frame, "g", "id", "text").collect()
    assert [(r["g"], r["a"], r["b"], r["pair"]) for r in got] == [("p", 1, 2, 0)]
    score = rules.meeting_score(F.lit("a@corp.com"), F.array(F.lit("b@corp.com"), F.lit("c@x.org")), F.lit("Corp sync"), F.lit("the budget"), ["corp.com"], ["corp"], ["budget"])
    assert value(spark, score) == 8
    assert value(spark, rules.negated_near(F.lit("you must never use discounts"), "discount", ("never",)))
    assert value(spark, rules.staging_path(F.lit("a/Misc/b"))) and not value(spark, rules.staging_path(F.lit("a/miscellany/b")))


def test_entities(spark):
    registry = spark.createDataFrame([("Anna Schmidt",), ("Bob Stone",)], "name string")
    aliases = spark.createDataFrame([("ann s", "Anna Schmidt")], "alias string, entity string")
    names = spark.createDataFrame([("anna schmidt",), ("Ann S",), ("Anna Schmid",), ("Bob Stonee",), ("Zoe",)], "name string")
    got = {r["name"]: (r["entity"], r["how"]) for r in entity.normalise(names, registry, aliases).collect()}
    assert got["anna schmidt"] == ("Anna Schmidt", "exact") and got["Ann S"] == ("Anna Schmidt", "alias")
    assert got["Anna Schmid"][1] == "merged" and got["Bob Stonee"][1] in ("merged", "review") and got["Zoe"] == ("Zoe", "new")
    rows = spark.createDataFrame([("s", "Anna Schmidt", 1), ("s", "Anna Schmidt PhD", 2), ("s", "Carl", 3)], "slug string, name string, position int")
    how = {r["name"]: r["how"] for r in entity.resolve_aliases(rows, "slug").collect()}
    assert how == {"Anna Schmidt": "canonical", "Anna Schmidt PhD": "alias", "Carl": "canonical"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: One\ntags: x\n---\nintro\n## First\ntext one\n## Second\ntext two")
    (tmp_path / "_skip.md").write_text("no")
    texts = readers.corpus(spark, [readers.Source("notes", f"{tmp_path}/*.md", "external")])
    row = texts.select("bucket", readers.frontmatter(F.col("text")).alias("m")).collect()
    assert [(r["bucket"], r["m"]) for r in row] == [("external", {"title": "One", "tags": "x"})]
    assert [(r["section"], r["name"]) for r in readers.markdown_sections(texts).orderBy("section").collect()] == [(0, ""), (1, "First"), (2, "Second")]
    for name, content in {"e": {"chunks": [{"id": "1", "text": "a"}]}, "l": [{"id": "2", "text": "b"}, {"id": "3", "text": " "}], "m": {"x": [{"id": "4", "text": "c"}], "y": [{"id": "5", "text": "d"}]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    assert {r["id"] for r in readers.json_artifacts(spark, f"{tmp_path}/*.json").collect()} == {"1", "2", "4", "5"}
    (tmp_path / "q.qrels").write_text(json.dumps({"schema_version": 1, "queries": [{"query_id": "q1", "query": "x", "relevant": [{"bucket": "business", "chunk_id": "c"}]}, {"query": "y", "relevant_chunk_ids": ["d"]}]}))
    assert {(r["query_id"], r["id"]) for r in readers.qrels(spark, f"{tmp_path}/q.qrels").collect()} == {("q1", "business::c"), ("entry-1", "external::d")}
    (tmp_path / "g.graph").write_text(json.dumps({"entities": {"a": {"id": "a", "type": "t"}}, "edges": [{"source": "a", "target": "b", "rel": "r"}]}))
    nodes, edges = readers.graph_tables(spark, f"{tmp_path}/g.graph")
    assert nodes.count() == 1 and edges.first()["target"] == "b"


def test_yaml_reader_and_sink(spark):
    pytest.importorskip("yaml")
    texts = spark.createDataFrame([("p", "rules:\n- id: r1\n  text: one\n  dominios: [x]\n- id: r2\n"), ("bad", "a: [")], "path string, text string")
    assert [(r["id"], r["domain"]) for r in readers.yaml_entries(texts).orderBy("id").collect()] == [("r1", "x"), ("r2", "")]
    assert "id: 1" in writers.yaml_rows(spark.createDataFrame([(1,)], "id long")).first()["entry"]


def test_versioned_table(spark, tmp_path):
    table = writers.VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.read() is None
    row = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    table.upsert(row((1, "a"), (2, "b")), ["id"])
    table.upsert(row((2, "c"), (3, "d")), ["id"])
    table.delete(row((1, "")), ["id"])
    assert {tuple(r) for r in table.read().collect()} == {(2, "c"), (3, "d")}


def test_streams_equal_batches(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = streams.table_stream(spark, f"{tmp_path}/in", source.schema, 1)

    def run(frame, mode, name):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination(120)
        return spark.table(name)

    totals = run(streams.running_totals(stream, "event_type", "value"), "complete", "totals")
    want = {r["event_type"]: r["n"] for r in source.groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    assert {r["event_type"]: r["n"] for r in totals.collect()} == want
    once = run(streams.once_within(stream, F.col("user_id"), "ts", 365), "append", "once")
    assert once.count() == source.select("user_id").distinct().count()


def test_stateful_streams(spark, tmp_path):
    rows = [("a", "h1", 5), ("b", "h2", 5), ("a", "h3", 9)]
    spark.createDataFrame(rows, "key string, body_hash string, words int").coalesce(1).write.parquet(f"{tmp_path}/r")
    stream = spark.readStream.schema("key string, body_hash string, words int").parquet(f"{tmp_path}/r")
    q = streams.registry_verdicts(stream).writeStream.format("memory").queryName("verdicts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    assert {(r["key"], r["body_hash"], r["verdict"]) for r in spark.table("verdicts").collect()} == {("a", "h1", "process"), ("b", "h2", "process"), ("a", "h3", "incremental")}


def test_lease_steps():
    s = None
    for event, at, want in (("enqueue", 0, "waiting"), ("claim", 1, "active"), ("beat", 20, "active"), ("tick", 60, "waiting"), ("claim", 61, "active"), ("tick", 100, "waiting"), ("claim", 101, "active"), ("finish", 102, "done")):
        s = streams.lease_step(s, event, at, 30)
        assert s[0] == want, (event, at, s)


def test_library_without_llm():
    """Nothing outside the subpackage imports it."""
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1]
    for path in (root / "lodegraph").rglob("*.py"):
        if "llm" not in path.parts:
            assert "lodegraph.llm" not in path.read_text(), path
