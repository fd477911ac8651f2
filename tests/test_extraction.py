"""Records of several shapes and patterns in text."""

from __future__ import annotations

import json

from lodegraph.operators import extraction as X
from pyspark.sql import functions as F


def test_records(spark):
    rows = spark.createDataFrame([(json.dumps({"id": "1", "insight": "raise prices", "quote": "we did", "speaker": "Ann", "confidence": "0.8"}),), (json.dumps({"chunk_id": "2", "summary": "s", "insight": "x", "priority": "high"}),)], "raw string")
    got = {r["insight_id"]: tuple(r)[1:] for r in X.normalised_insights(rows).collect()}
    assert got == {"1": ("raise prices\nwe did", "Ann", "MEDIUM", 0.8), "2": ("s", None, "HIGH", None)}
    shapes = spark.createDataFrame([('{"themes": ["B ", "a"], "roles": []}',), ('{"topics": ["T"]}',), ("{}",)], "raw string")
    assert [(r[0], r[1]) for r in shapes.select(X.record_format(F.col("raw")), X.themes(F.col("raw"))).collect()] == [("ah", ["a", "b"]), ("rag", ["t"]), ("unknown", [])]


def test_organisation_and_business(spark):
    texts = spark.createDataFrame([(1, "The closer reports to the sales manager. The ceo leads the board, team of 12 and $1.5 million in revenue; the sdr team")], "doc_id long, text string")
    got = {(r["relation"], r["upper"], r["lower"]) for r in X.organisation(texts, ["closer", "ceo"]).collect()}
    assert got == {("reports_to", "sales manager", "closer"), ("manages", "ceo", "board")}
    fact = X.business_facts(texts, {"sdr": "sales", "sales": "sales", "ops": "operations"}).first()
    assert (fact["departments"], fact["team"], fact["amount"]) == (["sales"], 12, 1_500_000.0)


def test_procedures_filters_budgets(spark):
    frame = spark.createDataFrame([("1. open it\n2. close it\n- check the log\nthis process",), ("1. one",)], "t string")
    assert [r[0] for r in frame.select(X.procedure_score(F.col("t"))).collect()] == [35, 0]
    assert X.parse_filters("a=b, c = d,=x,y") == {"a": "b", "c": "d"} and X.parse_filters(None) == {}
    assert tuple(spark.range(1).select(X.memory_budget(F.lit("analytical")).alias("b")).first()["b"]) == (12000, 8400, 3600)


def test_faithfulness_and_gate(spark):
    answers = spark.createDataFrame([(1, "The price was raised before the call. It might rain tomorrow in town."), (2, "Nothing here matches the given chunk at all."), (3, "Short.")], "answer_id long, text string")
    chunks = spark.createDataFrame([(1, "they raised the price before every call"), (2, "price")], "answer_id long, chunk string")
    got = {r["answer_id"]: (r["faithfulness"], r["verdict"]) for r in X.faithfulness(answers, chunks).collect()}
    assert got == {1: (1.0, "faithful"), 2: (0.0, "unfaithful"), 3: (1.0, "faithful")}
    judged = X.gate(X.faithfulness(answers, chunks), F.lit(0.7))
    assert {r["answer_id"]: r["verdict"] for r in judged.collect()} == {1: "pass", 2: "pass_external", 3: "pass"}


def test_inbox(spark):
    files = spark.createDataFrame([("in/ann/a.PDF",), ("in/ann/.b.txt",), ("in/bob/c.md",), ("in/bob/d.part",)], "path string")
    got = {(r["folder"], r["name"], r["kind"]) for r in X.inbox(files, {"pdf": "document", "md": "markdown"}).collect()}
    assert got == {("ann", "a.PDF", "document"), ("bob", "c.md", "markdown")}
