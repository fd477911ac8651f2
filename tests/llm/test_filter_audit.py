"""Operator 12 against brute force over rows, orders and steps."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest
from lodegraph.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    good = {r["doc_id"] for r in labels if r["quality"] == 1 and r["doc_id"] is not None}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1 and r["doc_id"] is not None}
    first = {}
    for r in docs:
        if r["doc_id"] is not None:
            text = r["text"] or ""
            first[text] = min(first.get(text, r["doc_id"]), r["doc_id"])
    rows = []
    for r in docs:
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": r["doc_id"] is not None and first[text] < r["doc_id"],
        }
        rows.append((r["source"] or "", {k for k, v in fails.items() if v}, r["doc_id"] in good, r["doc_id"] in toxic))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for step, letter in enumerate(order, 1):
            for part in {p for p, *_ in rows}:
                mine = [x for x in rows if x[0] == part]
                alive = [x for x in mine if not x[1] & set(order[: step - 1])]
                gone = [x for x in alive if letter in x[1]]
                shapley[part, letter] += len(gone)
                redundant = [x for x in mine if letter in x[1] and x[1] & set(order[: step - 1])]
                out[part, "".join(order), step] = (len(alive) - len(gone), len(gone), len(redundant), sum(x[1] == {letter} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_every_order_and_step(spark, sf, which, request):
    docs = request.getfixturevalue(which)
    if which == "odd":
        rows = [(4, 1, 0), (5, None, 1), (5, 1, 0), (6, 0, None), (None, 1, 1), (7, 1, 1), (99, 1, 1)]
        labels = spark.createDataFrame(rows, LABELS)
        more = [(i, "the same text said twice over and over" if i % 2 else "A # B", "en", "ab"[i % 3 > 0], 1, 5) for i in range(20, 60)]
        docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).unionByName(spark.createDataFrame([(None, "A # B", "en", "a", 1, 5)], docs.schema))
    else:
        labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = filter_audit.op12_filter_audit(docs, labels).collect()
    want = brute(docs.collect(), labels.collect())
    assert len(got) == len(want)
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in got} == want


def test_empty_tables_and_clashing_columns(spark, docs, empty):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.op12_filter_audit(empty, none).count() == 0
    clash = docs.selectExpr("*", "1 AS part", "2 AS mask", "3 AS digest", "4 AS good", "5 AS n", "6 AS first", "7 AS least")
    rows = filter_audit.op12_filter_audit(clash, none).collect()
    assert rows and not any(r["good_lost"] or r["toxic_lost"] for r in rows)


def test_transform_inverts_exactly(spark):
    cells = spark.createDataFrame([("p", m % 2, m % 3 % 2, m, 7 * m * m + 1) for m in range(32)], "part string, good int, toxic int, mask int, n long")
    got = filter_audit.cell_counts(filter_audit.parity_sums(cells)).collect()[0]
    assert got["all"] == [7 * m * m + 1 for m in range(32)]
    assert got["good"] == [(7 * m * m + 1) * (m % 2) for m in range(32)]
    assert got["toxic"] == [(7 * m * m + 1) * (m % 3 % 2) for m in range(32)]
