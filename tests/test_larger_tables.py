"""Queries that went wrong, failed or took too long on larger tables, on small tables of the kind that showed it."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher
from functools import reduce
from operator import add

import duckdb
import pytest
from lodegraph.operators import citing, entity, evals, extraction, retrieval, vector_index, vector_scan, word_scan
from lodegraph.plans import catalogue
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def tables(path, **frames):
    for name, frame in frames.items():
        frame.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def equals_sql(spark, name, folder, *names):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in names:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name])
    found = catalogue.QUERIES[name](spark, folder).select(*want.columns)
    shown = lambda rows: sorted([tuple("" if v is None else v for v in r) for r in rows], key=str)
    return shown(map(tuple, found.collect())) == shown(want.fetchall())


def test_teams_of_any_size_are_facts(spark, tmp_path):
    events = spark.createDataFrame([(i,) for i in (0, 5, 100_000, 100_001, 123_456, 999_999, 1_000_001, 1_234_567)], "event_id long")
    assert equals_sql(spark, "business_facts", tables(tmp_path, events=events), "events")
    texts = spark.createDataFrame([(1, "a team of 9 and a team of 100001"), (2, "a team of 1000001"), (3, "a team of 99999999999 or a team of 3")], "doc_id long, text string")
    teams = lambda **more: {r["id"]: r["team"] for r in extraction.business_facts(texts, {"hr": "people"}, **more).collect()}
    assert teams() == {1: 9, 2: None, 3: 3} and teams(largest=None) == {1: 100_001, 2: 1_000_001, 3: 3}


def test_gaps_are_between_rounded_seconds(spark, tmp_path):
    """86400.4 s from .3 to .7 of a second is a gap of 86401 s in SQL; 86400.5 s from .9 to .4 is one of 86400."""
    at = lambda d, us: f"TIMESTAMP '2026-01-0{d} 00:00:00' + make_dt_interval(0, 0, 0, {us})"
    rows = [(1, at(1, 0.3), "view"), (1, at(2, 0.7), "view"), (2, at(1, 0.9), "view"), (2, at(2, 1.4), "view"), (2, "NULL", "view"), (3, at(1, 0.5), "purchase"), (3, at(1, 0.5), "purchase"), (3, at(1, 0.5), "view"), (3, at(2, 1.5), None)]
    picked = [f"SELECT {u}L AS user_id, CAST({t} AS TIMESTAMP_NTZ) AS ts, CAST({f'{k!r}' if k else 'NULL'} AS STRING) AS event_type" for u, t, k in rows]
    folder = tables(tmp_path, events=spark.sql(" UNION ALL ".join(picked)))
    assert equals_sql(spark, "run_segmentation", folder, "events")
    runs = {(r["user_id"], r["run"], r["n"]) for r in catalogue.QUERIES["run_segmentation"](spark, folder).collect()}
    assert {(1, 0, 1), (1, 1, 1), (2, 0, 3)} <= runs


def test_citations_repeat_no_words_for_each_word(spark):
    """A row of all words for each word of a text shuffles as little and was broadcast as much: the driver ran out of memory."""
    texts = [" ".join(f"word{i * 7 % 400} topic{i}" for i in range(n, n + 60)) for n in range(40)]
    paragraphs = spark.createDataFrame([("all", f"p{i}", t + " and so on") for i, t in enumerate(texts)], "owner string, paragraph string, text string")
    entries = spark.createDataFrame([("all", f"e{i}", t) for i, t in enumerate(texts)], "owner string, entry string, text string")
    found = citing.fuzzy_citations(paragraphs, entries, "owner")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan.replace("Generate explode(named", "")
    assert {(r["paragraph"], r["entry"]) for r in found.where("rank = 1").collect()} == {(f"p{i}", f"e{i}") for i in range(40)}


def test_bounded_ratio_is_the_ratio(spark):
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, 60))) * rng.choice((1, 1, 5)) for _ in range(2))
        matcher = SequenceMatcher(None, a, b)
        want = matcher.ratio()
        for floor in (0.2, 0.45, want, 0.9):
            assert citing._ratio(matcher, len(a), len(b), floor) == want or want < floor


def test_numbered_names_find_their_own(spark):
    """All pairs of numbered names are alike; the best candidate lacks one letter or has one more. Brute force agrees."""
    registry = [f"Supplier#{i:09d}" for i in range(120)] + ["", "a", "ab", "aba", "abab", "Supplier#00000007", "SUPPLIER#000000011", "banana", "bananana"]
    asked = [f"{x}x" for x in registry] + ["b", "ba", "bab", "supplier#000000007", "Supplier#0000000", "bananan", "Kupplier#000000012", "Supplier#000000x99"]
    frame = lambda names: spark.createDataFrame([(x,) for x in names], "name string")
    for floor in (0.85, 0.6):
        want = {}
        for x in asked:
            ratio, best = max((SequenceMatcher(None, x.lower(), y.lower()).ratio(), [-ord(k) for k in y] + [1], y) for y in registry)[::2]
            if ratio >= floor:
                want[x] = (best, ratio)
        assert {r["name"]: (r["candidate"], r["ratio"]) for r in entity.best_match(frame(asked), frame(registry), floor).collect()} == want


def test_numbered_names_make_no_pairs_of_all(spark, monkeypatch):
    """A thousand numbered names are settled by an equi-join: none is left for the comparison of all that may be alike."""
    monkeypatch.setattr(entity, "similar_pairs", lambda *_: pytest.fail("names were left"))
    names = spark.range(1000).select(F.format_string("Supplier#%09d", "id").alias("name"))
    got = entity.best_match(names.select(F.concat("name", F.lit("x")).alias("name")), names)
    assert got.where("name = concat(candidate, 'x') AND abs(ratio - 36 / 37d) < 1e-12").count() == 1000


def cosine(x, y):
    """As text.dot of text.unit has it: plain sums in the order of the components, which Python's sum is not."""
    added = lambda numbers: reduce(add, numbers, 0.0)
    lengths = [added(v * v for v in z) ** 0.5 for z in (x, y)]
    a, b = ([v / n if n > 0 else 0.0 for v in z] for z, n in zip((x, y), lengths))
    return added(p * q for p, q in zip(a, b))


@pytest.mark.parametrize("numbers", [1 << 20, 64])
def test_scan_equals_all_pairs(spark, monkeypatch, numbers):
    """Copies, ties, zeros, nulls, right angles and vectors of several lengths, in one block of queries and in many, ids as texts."""
    monkeypatch.setattr(vector_scan, "QUERY_NUMBERS", numbers)
    rng = random.Random(8)
    vectors = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(300)] + [[1.0, 1.0] + [0.0] * 6] * 40 + [[0.0] * 8, None, [1.0, -1.0] + [0.0] * 6, [0.3, 0.4], [0.4, 0.3], [], [1e-200] + [0.0] * 7]
    rows = [(f"v{i:03d}", v) for i, v in enumerate(vectors)]
    asked = [(f"q{i}", v) for i, v in enumerate([*vectors[:30], *vectors[298:301], *vectors[340:]])]
    frame = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    queries = spark.createDataFrame(asked, "query_id string, vector array<double>")
    for k, floor in ((5, 0.0), (50, -0.2), (None, 0.4)):
        want = set()
        for q, x in asked:
            met = sorted((-round(cosine(x, y), 9), i, cosine(x, y)) for i, y in rows if x is not None and y is not None and len(x) == len(y) and cosine(x, y) > floor)
            want |= {(q, i, s, n) for n, (_, i, s) in enumerate(met[:k], 1)}
        got = retrieval.vector_topk(frame, queries, k, floor)
        assert {(r["query_id"], r["id"], r["score"], r["rank"]) for r in got.collect()} == want
    assert retrieval.vector_topk(frame, queries.limit(0)).count() == retrieval.vector_topk(frame.limit(0), queries).count() == 0


def test_vector_search_makes_no_rows_of_all_pairs(spark, tmp_path):
    """No join in the plan gives a row for each vector and query; a task returns k rows a query."""
    rows = spark.createDataFrame([(i, [random.Random(16 * i + j).gauss(0, 1) for j in range(16)], i % 10) for i in range(2000)], "vec_id long, embedding array<float>, label int")
    folder = tables(tmp_path, embeddings=rows)
    for name in ("cosine_topk", "cosine_floor"):
        assert "Join" not in catalogue.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert equals_sql(spark, name, folder, "embeddings")


def test_relevant_items_are_counted_by_class(spark, tmp_path):
    """Items of the query's class are counted, and pairs made of the results alone; nulls are of no class."""
    rows = [(i, [random.Random(4 * i + j).gauss(0, 1) for j in range(4)], None if i in (50, 51) else i % 2 if i < 900 else 7) for i in range(1001)]
    folder = tables(tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert equals_sql(spark, "recall_ndcg", folder, "embeddings") and equals_sql(spark, "id_precision", folder, "embeddings")
    results = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 9, 1)], "query_id int, id int, rank int")
    queries, items = (spark.createDataFrame(x, f"{c} int, label string") for x, c in (([(1, "a"), (2, "b"), (3, None), (4, "a")], "query_id"), ([(2, "a"), (3, "b"), (5, "a"), (9, None)], "id")))
    pairs, total = evals.relevant_by_class(results, queries, items)
    assert {tuple(r) for r in pairs.collect()} == {(1, 2), (2, 3)} and {tuple(r) for r in total.collect()} == {(1, 2), (2, 1), (4, 2)}
    got = {r["query_id"]: (r["hits"], r["recall"], r["first_hit"]) for r in evals.retrieval_metrics(results, pairs, 10, total).collect()}
    assert got == {1: (1, 0.5, 1), 2: (1, 1.0, 1), 4: (0, 0.0, None)}


def test_index_search_makes_no_row_for_each_list(spark):
    """Queries are not repeated for the lists that they look into; the exact way equals the scan where copies fill a list, and where nothing passes."""
    vectors = [[random.Random(9 * i + j).gauss(0, 1) for j in range(8)] for i in range(400)] + [[1.0] * 8] * 300 + [[0.0] * 8] * 5
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id int, embedding array<double>")
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(vectors) if i % 40 == 0] + [(900, [1.0] * 8), (901, None), (902, [1.0]), (903, [-1.0] * 8)], "query_id int, vector array<double>")
    index = vector_index.build(frame)
    for search in (vector_index.search, vector_index.search_exact):
        assert "Join" not in search(index, queries)._jdf.queryExecution().optimizedPlan().toString()
    shown = lambda f: {tuple(r) for r in f.select("query_id", "id", "score", "rank").collect()}
    assert shown(vector_index.search_exact(index, queries, 7, probes=1)) == shown(retrieval.vector_topk(frame, queries, 7))
    assert shown(vector_index.search_exact(index, queries, 7, floor=0.9)) == shown(retrieval.vector_topk(frame, queries, 7, 0.9))
    assert shown(vector_index.search(index, queries, 7, probes=len(index.centroids))) == shown(retrieval.vector_topk(frame, queries, 7))


def test_longest_aliases_are_kept_before_the_shuffle(spark):
    """Aliases of a few rows shuffle no grams, and a text's best is kept within a task; brute force agrees, with gaps in the lengths of aliases."""
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice("ab cd ef gh The OF, x1 é".split()) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(900, None), (901, ""), (902, "ab")]
    aliases = [("ab", "e1"), ("AB", "e0"), ("cd ef gh", "e2"), ("the of", "e3"), ("gh é the x1", "e4"), ("a b c d e", "e5"), (None, "e6"), ("ab-cd", "e7")]
    known = {}
    for alias, entity_ in aliases:
        if alias:
            known[alias.lower()] = max(entity_, known.get(alias.lower(), ""))
    want = set()
    for i, text in texts:
        w = re.findall("[a-z0-9à-ɏ]+", (text or "").lower())
        grams = ((" ".join(w[at : at + n])) for n in (4, 3, 2, 1) for at in range(len(w) - n + 1))
        want |= {(i, known[g], g) for g in [next((g for g in grams if g in known), None)] if g}
    frames = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(aliases, "alias string, entity string")
    found = entity.alias_matches(*frames, "doc_id", "text")
    assert {tuple(r) for r in found.collect()} == want and len({g for _, _, g in want}) == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan
    assert entity.alias_matches(frames[0], frames[1].limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("rows", [512, 2])
def test_word_search_shuffles_no_postings(spark, monkeypatch, rows):
    """The best documents of each query by plain BM25, with copies, repeated terms, nulls and queries without words, in one block of queries and in many."""
    monkeypatch.setattr(word_scan, "QUERY_ROWS", rows)
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("en", "er", "ung")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += texts[:40] + [None, "", "12 3", "AEN aen!"]
    asked = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(9)] + ["", "nowhere at all", "aen aen aen"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    tokens = lambda t: re.findall("[a-zà-ɏ]{2,}", (t or "").lower())
    held = [Counter(tokens(t)) for t in texts]
    mean, want = sum(sum(h.values()) for h in held) / len(held), {}
    for q, text in enumerate(asked):
        scores = {}
        for i, h in enumerate(held):
            for term, times in Counter(tokens(text)).items():
                df = sum(term in x for x in held)
                if h[term]:
                    scores[i] = scores.get(i, 0) + times * math.log((len(held) - df + 0.5) / (df + 0.5) + 1) * h[term] * 2.5 / (h[term] + 1.5 * (0.25 + 0.75 * sum(h.values()) / mean))
        want |= {(q, i): (round(s, 9), n) for n, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:7], 1)}
    found = retrieval.bm25(frame, queries, 7)
    assert {(r["query_id"], r["id"]): (round(r["score"], 9), r["rank"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert retrieval.bm25(frame.limit(0), queries, 7).count() == retrieval.bm25(frame, queries.limit(0), 7).count() == 0
