"""Policies, grades, plan and status checks, direct answers and reuse, against values worked out by hand."""

from __future__ import annotations

from lodegraph.operators import governance as G
from lodegraph.operators import resolving as R
from pyspark.sql import functions as F


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_quality_of_empty_null_and_full_texts(spark):
    full = "\n".join(["### mental frameworks heuristics methodologies philosophies", "--- contexto destino arquivo batch"] * 3 + ["- item [FONTE:a]"] * 50)
    texts = spark.createDataFrame([(1, None), (2, ""), (3, full), (4, "^[a] # x")], "id int, t string")
    found = {r.id: r.q for r in texts.select("id", G.quality_score(F.col("t")).alias("q")).collect()}
    assert [found[i].total for i in (1, 2)] == [0, 0] and found[1].grade == "F"
    assert tuple(found[3]) == (25, 25, 25, 25, 100, "A")
    assert found[4].traceability == 10 and found[4].clarity == 0


def test_line_counts_are_those_of_a_splitter_of_lines(spark):
    texts = ["", "a", "a\n", "a\r\nb", "\n\n", "a b\x85"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", G.line_count(F.col("t")).alias("n"))
    assert dict(rows(frame)) == {i: len(t.splitlines()) for i, t in enumerate(texts)}


def test_layers_of_paths(spark):
    want = {
        "x/old_tmp/a": "DELETE", "keys/a": "NEVER", "a/.env": "NEVER", "a/.env.example": "REVIEW", "me/a": "L3", "me/README.md": "L1", "me/x/_example/a": "L1",
        "pro/a": "L2", "pro/.gitkeep": "L1", "core/a": "L1", "setup.cfg": "L1", "b/setup.cfg": "REVIEW", "b/notes 2.md": "DELETE",
    }
    frame = spark.createDataFrame([(p,) for p in want], "p string")
    assert dict(rows(frame.select("p", G.layer_of(F.col("p"), ("old_tmp",), ("keys/", ".env"), ("me/",), ("pro/",), ("core/", "setup.cfg"))))) == want


def test_a_limit_counts_allowed_calls_alone(spark):
    calls = spark.createDataFrame([(i, "s", a) for i, a in enumerate(["x", "y", "x", "x", "y"])] + [(9, "free", "z"), (10, "none", "x")], "at int, step string, action string")
    policies = spark.createDataFrame([("s", "whitelist", ["x"], 2), ("none", "blacklist", [], 0)], "step string, mode string, actions array<string>, max_calls int")
    found = {r["at"]: (r.allowed, r.reason) for r in G.policy_decisions(calls, policies, ("at",)).collect()}
    assert found == {0: (True, "ok"), 1: (False, "whitelist:y"), 2: (True, "ok"), 3: (False, "max_calls"), 4: (False, "max_calls"), 9: (True, "ok"), 10: (False, "max_calls")}


def test_policies_may_be_none(spark):
    calls = spark.createDataFrame([(1, "s", "x")], "at int, step string, action string")
    policies = spark.createDataFrame([], "step string, mode string, actions array<string>, max_calls int")
    assert G.policy_decisions(calls, policies, ("at",)).first().allowed


def test_contract_ties_go_to_the_first(spark):
    asked = spark.createDataFrame([("Sell and SHIP",), ("ship it now",), ("",), (None,)], "q string")
    found = [r.c and tuple(r.c) for r in asked.select(R.contract_of(F.col("q"), {"a": ("sell",), "b": ("ship", "now")}).alias("c")).collect()]
    assert found == [("a", 1), ("b", 2), None, None]


def test_the_file_beyond_the_bound_is_cut_or_left(spark):
    files = spark.createDataFrame([("g", 1, "a" * 500), ("g", 2, "b" * 500), ("g", 3, "c"), ("h", 1, "a" * 900), ("h", 2, "b" * 500), ("h", 3, None)], "g string, n int, t string")
    found = R.bounded_files(files, "g", "n", "t", most=1000).select("g", "n", "taken")
    assert rows(found) == [("g", 1, 500), ("g", 2, 500), ("h", 1, 900)]
    cut = R.bounded_files(files.where("g = 'g'"), "g", "n", "t", most=800)
    assert [(r.n, len(r.t)) for r in cut.orderBy("n").collect()] == [(1, 500), (2, 300)]


def test_an_artifact_comes_before_the_prior_vector(spark):
    schema = "sha string, model string, vector array<float>, ord int"
    prior = spark.createDataFrame([("a", "m", [1.0, 0.0], 1), ("b", "m", [1.0, 0.0], 1), ("c", "old", [1.0, 0.0], 1), ("d", "m", [1.0], 1)], schema)
    new = spark.createDataFrame([("a", "m", [0.0, 1.0], 1), ("a", "m", [0.5, 0.5], 2), ("b", "old", [0.0, 1.0], 1)], schema)
    assert rows(R.seeded_vectors(prior, new, "m", 2)) == [("a", [0.5, 0.5], "artifact"), ("b", [1.0, 0.0], "prior")]


def test_an_overlay_replayed_twice_adds_nothing(spark):
    nodes = spark.createDataFrame([("p:ann", "pessoa", "Ann")], "id string, type string, label string")
    overlay = spark.createDataFrame(
        [("met", None, ["p:ann", "p:bo", "p:ann"], {"p:ann": "Other"}), ("met", None, ["p:bo", "p:ann"], {}), (None, None, ["p:x"], {}), ("met", None, [], {})],
        "rel_label string, rel_type string, participants array<string>, labels map<string,string>",
    )
    once, edges = R.overlay_replayed(nodes, overlay)
    twice, again = R.overlay_replayed(once, overlay)
    assert rows(once) == rows(twice) and rows(edges) == rows(again)
    assert sorted((r.type, r.label) for r in once.collect()) == [("hyperedge", "met"), ("pessoa", "Ann"), ("pessoa", "bo")]
    assert edges.count() == 2 and edges.select("rel").distinct().first().rel == "PARTICIPA"


def test_records_without_a_key_are_not_merged(spark):
    records = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), ("k", 3, "c"), ("k", 4, "d")], "id string, ord int, v string")
    target = spark.createDataFrame([("k", 0, "old"), ("z", 0, "kept")], "id string, ord int, v string")
    assert rows(R.merged_sidecar(records, "id", "ord", target).select("id", "v")) == [("k", "d"), ("row:1", "a"), ("row:2", "b"), ("z", "kept")]


def test_layers_of_documents_and_their_tier(spark):
    files = spark.createDataFrame([("workspace", "u/L4/a.md", ""), ("workspace", "u/b.md", "t" * 120), ("workspace", "L4", None)], "kind string, path string, title string")
    docs, edges = R.source_documents(files, {"L4": 7}, 30)
    found = {r.id: (r.label, r.tier, r.layer, r.ttl_days) for r in docs.collect()}
    assert found["DOC:workspace:u/L4/a.md"] == ("a", "raw", "L4", 7)
    assert found["DOC:workspace:u/b.md"] == ("t" * 100 + "...", "structured", None, None)
    assert found["DOC:workspace:L4"] == ("L4", "structured", None, None)
    assert edges.count() == 3 and "FONTE:workspace" in found
