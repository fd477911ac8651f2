"""Knowledge-base joins and roll-ups on hand-sized inputs."""

from __future__ import annotations

import pytest
from lodegraph.operators import knowledge as K
from pyspark.sql import functions as F


@pytest.fixture
def rows(spark):
    return lambda schema, *data: spark.createDataFrame(list(data), schema)


def got(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_filters(rows):
    chunks = rows("bucket string, chunk_id string", ("a", "1"), ("b", "2"))
    assert got(K.granted(chunks, rows("agent string, bucket string", ("x", "a")), "x"), "chunk_id") == [("1",)]
    files = rows("path string, sha string", ("p", "1"), ("q", "2"), ("r", "3"))
    assert got(K.changed_files(files, rows("path string, sha string", ("p", "1"), ("q", "9"))), "path") == [("q",), ("r",)]
    assert got(K.pending(files, rows("path string, status string", ("p", "completed"), ("q", "failed"))), "path") == [("q",), ("r",)]
    assert got(K.uncited(chunks, rows("chunk_id string", ("1",))), "chunk_id") == [("2",)]
    truth = rows("query string, chunks array<string>, confidence string, position int", ("a", ["c"], "HIGH", 1), ("b", [], "HIGH", 2), ("c", ["c"], "LOW", 3), ("d", ["c"], "0.75", 4), ("e", ["c"], "?", 5))
    assert got(K.ground_truth(truth), "query") == [("a",), ("d",), ("e",)]
    assert got(K.matching_communities(rows("community string, weight double", ("sales-team", 2.0), ("ops", 1.0)), "the sales plan"), "community", "score") == [("sales-team", pytest.approx(2 / 3))]


def test_citations(rows):
    paragraphs = rows("owner string, paragraph string, text string", ("o", "p1", "always raise the price before the call"))
    entries = rows("owner string, entry string, text string", ("o", "e1", "raise the price before the call"), ("o", "e2", "price things"), ("z", "e3", "raise the price before the call"))
    assert [(r["entry"], r["rank"]) for r in K.fuzzy_citations(paragraphs, entries, "owner").collect()] == [("e1", 1)]
    sections = rows("section string, text string", ("s", "we use anchor and frame here"), ("t", "see e9"))
    keys = rows("entry string, keywords array<string>", ("e8", ["anchor", "frame", "close", "deal"]), ("e9", ["none"]))
    assert got(K.keyword_citations(sections, keys), "section", "entry", "score") == [("s", "e8", 1.0), ("t", "e9", 0.9)]
    chunks = rows("file string, section string, chunk_id string", ("d 2.md", "Intro", "c1"), ("d.md", "intro", "c2"))
    assert got(K.section_chunks(rows("file string, section string", ("d.md", "INTRO"), ("d.md", "x")), chunks), "section", "chunk_ids") == [("INTRO", ["c1", "c2"]), ("x", [])]


def test_agents(rows):
    insights = rows("id int, theme string, framework string", (1, "t", "f"), (2, "u", None))
    themes, frames = rows("theme string, agents array<string>", ("t", ["b", "a"])), rows("framework string, agents array<string>", ("f", ["a", "c"]))
    assert got(K.agents_of(insights, themes, frames), "id", "agents") == [(1, ["a", "b", "c"]), (2, [])]
    picked = K.select_agents(rows("domain string, score double", ("d", 1.0)), rows("domain string, agent string, level string", ("d", "x", "primary"), ("d", "y", "secondary")), rows("agent string", ("z",)))
    assert [(r["agent"], r["score"]) for r in picked.collect()] == [("z", 1.0), ("x", 0.6), ("y", 0.3)]


def test_coverage_and_differences(rows):
    s = rows("source string", ("a",), ("b",))
    out = K.coverage(s, "source", chunks=s, dossier=rows("source string", ("a",)))
    assert got(out, "source", "chunks", "dossier", "share") == [("a", True, True, 1.0), ("b", True, False, 0.5)]
    one = K.flattened(rows("j string", ('{"a": {"b": 1, "c": [1, 2]}, "started_at": "x"}',)), "j")
    two = K.flattened(rows("j string", ('{"a": {"b": 2}, "d": true, "started_at": "y"}',)), "j")
    assert got(one, "key", "value") == [("a.b", "1"), ("a.c", "[1,2]"), ("started_at", "x")]
    assert got(K.flat_difference(one, two), "key", "change") == [("a.b", "changed"), ("a.c", "removed"), ("d", "added")]


def test_graph_parts(rows):
    entries = rows("id string, domains array<string>, people array<string>", ("e", ["d1", "d2"], ["p"]))
    edges = K.edges_from_lists(entries, "id", belongs="domains", of="people")
    assert got(edges, "target", "rel") == [("d1", "belongs"), ("d2", "belongs"), ("p", "of")]
    nodes = rows("id string, type string, label string, person string", ("n", "idea", "price anchor", "p"), ("m", "domain", "price", None), ("k", "person", "bob", None), ("p", "person", "pia", None))
    assert got(K.seeds(nodes, "the anchor"), "id", "mass") == [("n", 0.5)]
    ranks = rows("id string, score double", ("n", 0.2), ("m", 0.9))
    assert got(K.associative(ranks, nodes), "id") == [("n",)]
    assert got(K.live_nodes(nodes, edges, rows("id string", ("zz",))), "id") == [("m",), ("n",), ("p",)]
    calls = rows("call string, text string", ("c", "Participants: Ann@x.com, bob@y.com, rec@bot.io\nDate: 2024-05-06\n"))
    assert [tuple(r) for r in K.call_participants(calls).collect()] == [("c", "2024-05-06", ["ann", "bob"])]


def test_rollups(rows):
    results = rows("person string, score double", ("a", 0.5), ("a", 0.9), ("b", 0.1))
    assert got(K.by_person(results, "a"), "side", "n", "best") == [("other", 1, 0.1), ("own", 2, 0.9)]
    entities = rows("id string, domains array<string>, weight double, layer string", ("x", ["Sales"], 1.0, "l1"), ("y", [], 1.0, "l2"))
    assert got(K.layered(entities, rows("source string, target string", ("x", "y")), "sales"), "id", "layer", "score") == [("x", "l1", 1.0), ("y", "l2", 0.7)]
    agg = K.domain_aggregate(rows("domain string, expert string, confidence string", ("d", "e", "HIGH"), ("d", "e", None)), rows("expert string, weight double", ("e", 2.0)))
    assert got(agg, "confidence", "weight", "expert_entries") == [(0.7, 2.0, 2), (0.9, 2.0, 2)]
    checks = rows("step string, name string, passed boolean, blocking boolean", ("s", "a", True, True), ("s", "b", False, False), ("t", "c", False, True))
    assert got(K.checks_passed(checks, "step"), "step", "percent", "failed", "gate") == [("s", 50.0, ["b"], True), ("t", 0.0, ["c"], False)]
    cases = rows("precision double, hit_rate double, n int, least_n int", (0.8, 1.0, 5, 3), (0.2, 0.5, 1, 4))
    assert [tuple(r) for r in K.suite(cases).collect()] == [(2, 0.5, 0.5, 0.75, 0.625)]
    files = rows("bucket string, modified long", ("a", 5), ("b", 5))
    assert got(K.stale(rows("bucket string, modified long", ("a", 9)), files), "bucket", "stale") == [("a", False), ("b", True)]
    assert K.same_dimension(rows("embedding array<double>", ([1.0, 2.0],), ([1.0],))).first()["consistent"] is False


def test_ranking_queue_and_waits(rows, spark):
    index = rows("key string, name string, path string, priority int", ("a", "pricing helper", "x/pricing", 1), ("b", "other", "x/y", 5))
    assert [(r["key"], r["score"]) for r in K.recommended(index, "help with pricing").collect()] == [("a", 25), ("b", 0)]
    old = rows("dedup_key string, v int", ("k", 1))
    assert got(K.merge_queue(old, rows("dedup_key string, v int", ("k", 2), ("m", 3))), "dedup_key", "v") == [("k", 1), ("m", 3)]
    now = F.lit("2015-10-21 07:27:00").cast("timestamp")
    values = rows("v string", ("120",), ("Wed, 21 Oct 2015 07:28:00 GMT",), ("soon",))
    assert [r[0] for r in values.select(K.retry_after(F.col("v"), now)).collect()] == [120.0, 60.0, None]
