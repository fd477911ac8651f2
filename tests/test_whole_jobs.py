"""Queries and operators that once did less than the whole job."""

from __future__ import annotations

import random
import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from itertools import combinations

from lodegraph.operators import entity, rules
from lodegraph.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def tables(spark, path, **frames):
    for name, frame in frames.items():
        frame.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_long_documents_and_null_lengths_are_chunked(spark, tmp_path):
    long_text = " ".join(f"Sentence number {i} is about topic {i % 7} and says a little more." for i in range(200))
    docs = spark.createDataFrame([(1, long_text, len(long_text)), (2, long_text, None)], "doc_id long, text string, n_chars long")
    got = catalogue.QUERIES["semantic_chunks"](spark, tables(spark, tmp_path, documents=docs)).collect()
    assert {r["doc_id"] for r in got} == {1, 2}


def test_antonym_sides_are_the_pairs_of_all_documents(spark, tmp_path):
    pad = " word" * 300
    texts = {1: "with", 2: "from" + pad, 3: "with from", 4: "avec" + pad, 5: "pour", 6: "none", 7: "with" + pad}
    rows = [(i, t, "a" if i < 7 else "b", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame([*rows, (8, "with from", "c", None)], "doc_id long, text string, source string, n_chars long")
    got = catalogue.QUERIES["antonym_sides"](spark, tables(spark, tmp_path, documents=docs)).collect()
    from_sides = {(x["source"], *sorted((x["doc_id"], y["doc_id"])), x["pair"]) for x in got for y in got if (x["source"], x["pair"]) == (y["source"], y["pair"]) and x["side"] < y["side"] and x["doc_id"] != y["doc_id"]}
    words = (("WITH", "FROM"), ("AVEC", "POUR"))
    brute = {("a", a, b, p) for a, b in combinations(range(1, 7), 2) for p, (x, y) in enumerate(words) for s, t in ((texts[a], texts[b]), (texts[b], texts[a])) if x in s.upper() and y in t.upper()}
    assert from_sides == brute and {(r["source"], r["a"], r["b"], r["pair"]) for r in rules.contradictions(docs, "source", "doc_id", "text", words).collect()} == brute
    assert {r["doc_id"]: r["opposites"] for r in got if r["pair"] == 0 and r["side"] == 0} == {1: 2, 3: 1}


def test_plans_have_all_parts(spark):
    parts = {r["p_partkey"]: float(r["p_size"]) for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect()}
    run = lambda name: catalogue.QUERIES[name](spark, FOLDER).collect()
    level, finish = {}, {}
    for k in sorted(parts):
        above = k // 2 if k > 1 and k // 2 in parts else None
        level[k], finish[k] = (level[above] + 1, finish[above] + parts[k]) if above is not None else (0, parts[k])
    assert max(parts) >= 40 and {r["id"]: r["level"] for r in run("plan_levels_whole")} == level
    assert {r["id"]: r["finish"] for r in run("plan_critical_path_whole")} == finish
    assert sum(r["n_nodes"] for r in run("plan_batches_whole")) == len(parts)
    assert max(r["id"] for r in run("plan_ready_whole")) >= 40 and max(r["id"] for r in run("stall_detect_whole")) >= 40


def test_pagerank_runs_all_its_rounds(spark):
    from lodegraph.operators import graph
    from lodegraph.plans.graph_queries import star

    nodes, edges = star(lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet"))
    ids, links = [r["id"] for r in nodes.collect()], [(r["source"], r["target"]) for r in edges.collect()]
    links += [(t, s) for s, t in links]
    degree = Counter(s for s, _ in links)
    seed = {i: 0.5 * (i in ("nation:1", "nation:2")) for i in ids}
    rank = dict(seed)
    for i in range(1, graph.ROUNDS + 1):
        new = {k: graph.ALPHA * v for k, v in seed.items()}
        loose = sum(v for k, v in rank.items() if not degree[k])
        for s, t in links:
            new[t] += (1 - graph.ALPHA) * rank[s] / degree[s]
        new = {k: v + (1 - graph.ALPHA) * loose * seed[k] for k, v in new.items()}
        change, rank = sum(abs(new[k] - rank[k]) for k in ids), new
        if i % 5 == 0 and change < graph.TOLERANCE:
            break
    got = {r["id"]: r["score"] for r in catalogue.QUERIES["ppr_converging"](spark, FOLDER).collect()}
    assert all(abs(got.get(k, 0.0) - v) < 2e-8 for k, v in rank.items())


def test_intents_read_the_whole_text(spark, tmp_path):
    late, short = "This question has quite some words before it asks to compare them", "Extraordinarily longwordedphrase of fivewords at first sight and more"
    items = spark.createDataFrame([(1, late), (2, short)], "item_id long, text string")
    got = {r["item_id"]: (r["intent"], r["pipeline"]) for r in catalogue.QUERIES["query_intents_whole"](spark, tables(spark, tmp_path, benchmark=items)).collect()}
    assert got == {1: ("factual_complex", "hybrid"), 2: ("analytical", "hybrid_graph")}


def test_best_match_is_the_best_of_all(spark):
    rng = random.Random(7)
    names = ["Schwarzkopff", "Yekaterina", "", "a", "ab", "É", "José", "aaaaaa", "Supplier#01"]
    for _ in range(60):
        names.append("".join(rng.choices("abcdeé ", k=rng.randint(1, 14))))
    registry = ["Shwarzkopf", "Ekaterinah", "", "A", "ba", "e", "Jose", "aaaaaab", "Supplier#02", "zzz"]
    for name in names[9:]:
        for _ in range(2):
            letters = list(name)
            letters[rng.randrange(len(letters))] = rng.choice("abcde")
            letters.insert(rng.randrange(len(letters) + 1), rng.choice(["", "", "x"]))
            registry.append("".join(letters))
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
    n, c = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in registry], "name string")
    for floor in (0.85, 0.7, 0.5):
        want = {}
        for x in set(names):
            ratio, best = max((SequenceMatcher(None, plain(x), plain(y)).ratio(), [-ord(k) for k in y] + [1], y) for y in set(registry))[::2]
            if ratio >= floor:
                want[x] = (best, ratio)
        assert {r["name"]: (r["candidate"], r["ratio"]) for r in entity.best_match(n, c, floor).collect()} == want
        assert want["Schwarzkopff"][0] == "Shwarzkopf" and want["Yekaterina"][0] == "Ekaterinah"


def test_traces_of_the_first_day_and_of_none_are_counted(spark, tmp_path):
    events = spark.sql("SELECT id AS event_id, CASE WHEN id < 6 THEN timestamp'2026-01-30 23:00:00' + make_dt_interval(0, 12 * int(id)) END AS ts FROM range(8)")
    got = catalogue.QUERIES["traces_by_day"](spark, tables(spark, tmp_path, events=events)).collect()
    assert {tuple(r) for r in got} == {("2026-01-30", 1, 0), ("2026-01-31", 2, 3), ("2026-02-01", 2, 7), ("2026-02-02", 1, 5), (None, 2, 13)}
    alone = events.where("event_id = 0").union(events.where("event_id = 1").selectExpr("event_id", "timestamp'2026-01-30 01:00:00'"))
    got = catalogue.QUERIES["traces_by_day"](spark, tables(spark, tmp_path / "one", events=alone)).collect()
    assert [tuple(r) for r in got] == [("2026-01-30", 2, 1)]
