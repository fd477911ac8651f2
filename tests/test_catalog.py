"""Catalogues and the bucket classifier."""

from __future__ import annotations

from lodegraph.operators import catalog as C
from pyspark.sql import functions as F


def test_inventory_and_index(spark, tmp_path):
    (tmp_path / "agents").mkdir()
    (tmp_path / "agents" / "a.md").write_text("one")
    (tmp_path / "x.txt").write_text("two")
    files = C.inventory(spark, str(tmp_path), {"/agents/": "agent"})
    assert {(r["kind"], r["n"], r["bytes"]) for r in C.layer_counts(files).collect()} == {("agent", 1, 3), ("other", 1, 3)}
    index = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", " ")], "id string, name string")
    assert {tuple(r) for r in C.invalid_entries(index).collect()} == {("a", "not unique"), ("b", "missing name")}
    rows = lambda c, *v: spark.createDataFrame(list(v), f"squad string, {c} string")
    squads = spark.createDataFrame([("s",), ("t",)], "squad string")
    got = {r["squad"]: (r["agents"], r["tasks"]) for r in C.routing_index(squads, rows("agent", ("s", "b"), ("s", "a")), rows("task", ("t", "z"))).collect()}
    assert got == {"s": (["a", "b"], []), "t": ([], ["z"])}


def test_evidence_and_frameworks(spark):
    frame = spark.createDataFrame([("in/2024-01-02 Anna Schmidt sales call FINAL.txt", "We use The Grand Slam Method and the Value Model daily")], "doc_id string, text string")
    assert frame.select(C.filename_evidence(F.col("doc_id"))).first()[0] == ["anna", "schmidt", "sales"]
    assert {r["framework"] for r in C.frameworks(frame).collect()} == {"Grand Slam Method", "Value Model"}


def test_bucket_classifier(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", F.col("lang").alias("label")).where(F.length("text") > 200)
    train, held = docs.where("abs(xxhash64(text)) % 2 = 0"), docs.where("abs(xxhash64(text)) % 2 = 1")
    got = C.predict_buckets(C.fit_buckets(train), held)
    trusted = got.where("bucket <> 'all'")
    assert trusted.count() > 0.5 * held.count() and trusted.where("bucket = label").count() > 0.9 * trusted.count()
