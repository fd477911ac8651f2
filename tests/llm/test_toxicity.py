"""Operator 11: the grammar on sentences written by hand, counts against brute force, accuracy on held-out rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pytest
from lodegraph.llm import toxicity
from pyspark.sql import functions as F

SEEDED = toxicity.Lexicon()


def kinds(text):
    return [(m.word, m.kind) for m in toxicity.matches(text, SEEDED)[0]]


@pytest.mark.parametrize(
    "text,want",
    [
        ("You are an idiot.", [("idiot", "insult+aimed")]),
        ("Der Dummkopf kam", [("dummkopf", "insult")]),
        ("He is not a moron", [("moron", "insult+denied+aimed")]),
        ("The paper said it was trash", [("trash", "insult+told")]),
        ("She wrote that you are scum", [("scum", "insult+told+aimed")]),
        ("I will kill you", [("kill", "threat")]),
        ("You should not hurt them", [("hurt", "threat+denied+aimed")]),
        ("to kill time", []),
        ("Not today. You loser!", [("loser", "insult+aimed")]),
        ("no word of that kind", []),
        ("", []),
        (None, []),
    ],
)
def test_grammar(text, want):
    assert kinds(text) == want


def test_weights_follow_the_context():
    of = lambda text: sum(m.weight for m in toxicity.matches(text, SEEDED)[0])
    assert of("he is not an idiot") < of("they said idiot") < of("idiot") < of("you idiot")


def test_a_copied_passage_counts_once_and_counts_equal_brute_force(spark, docs):
    rows = docs.where("doc_id < 60").select("text", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"), (F.col("doc_id") % 2).cast("int").alias("half"))
    rows = rows.unionByName(rows.limit(7))
    pairs = defaultdict(set)
    for r in rows.collect():
        words = re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        for p in zip(words, ["", *words]):
            pairs[p].add(("t" if r["toxic"] else "c") + str(r["half"]))
    want, of = Counter(), defaultdict(set)
    for (word, _), names in pairs.items():
        terms = {("w", word)} | {("b", word[:k]) for k in toxicity.PREFIXES if len(word) >= k} | {("e", word[-k:]) for k in toxicity.SUFFIXES if len(word) >= k}
        for t in terms:
            want.update({(*t, n): 1 for n in names})
            if {"t0", "t1"} & names:
                of[t].add(word)
    got = toxicity.term_counts(rows).collect()
    assert {(r["kind"], r["term"], n): r[n] for r in got for n in toxicity.COUNTS if r[n]} == dict(want)
    assert all(r["words"] == len(of[r["kind"], r["term"]]) for r in got)


def test_held_out_rows(spark, docs, odd):
    for frame in (docs, odd):
        got = frame.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
        assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_accuracy_on_rows_that_were_not_learned_from(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in read("labels").collect()}
    got = [r for r in toxicity.op11_toxicity(read("documents"), read("labels")).collect() if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] and labels[r["doc_id"]] for r in got)
    assert right >= 0.9 * sum(labels[r["doc_id"]] for r in got)
    assert right >= 0.98 * sum(r["predicted"] for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_other_columns_are_no_inputs(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    moved = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string"), "score": F.lit(1), "toxic": F.lit(1), "half": F.lit(2)})
    want = sorted(map(tuple, toxicity.op11_toxicity(docs, labels).collect()), key=str)
    assert sorted(map(tuple, toxicity.op11_toxicity(moved.repartition(3), labels).collect()), key=str) == want
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, toxicity.op11_toxicity(docs, flipped).collect()), key=str) == want


def test_odd_rows_and_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.op11_toxicity(empty, none).count() == 0
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 1), (5, 0, None), (None, 1, 1), (7, 1, None)], none.schema)
    for known in (none, labels):
        got = toxicity.op11_toxicity(odd, known).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    clauses = toxicity.matched_clauses(spark.createDataFrame([(1, "Hm, you idiot!"), (None, None)], "doc_id long, text string"), toxicity.Model(SEEDED)).collect()
    assert [tuple(r) for r in clauses] == [(1, 3, 13, "insult+aimed", "idiot", 6.0)]
