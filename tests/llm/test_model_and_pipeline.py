"""Operator 1 against held-out labels, and the pipeline's stages against brute force."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from lodegraph.llm import mixing, partenum, quality_model, secret_scan
from lodegraph.llm.common import saved
from lodegraph.llm.vocab import path_of


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_classifier_on_held_out_labels(spark, larger):
    labels = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in quality_model.op1_quality_model(larger).collect()}
    assert len(got) == larger.count()
    right = [got[d]["kept"] == bool(r["quality"]) for d, r in labels.items()]
    clean = [got[d]["kept"] for d, r in labels.items() if r["quality"]]
    assert np.mean(right) > 0.98 and np.mean(clean) > 0.995


def test_label_model_recovers_accuracies():
    """Votes drawn from known accuracies: the posterior separates the classes better than any one labeller."""
    rng = random.Random(2)
    k = len(quality_model.LABELLERS)
    hit = [0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.7, 0.85, 0.8][:k]
    counts, truth = Counter(), Counter()
    for _ in range(20_000):
        y = rng.random() < 0.7
        code = 0
        for h in hit:
            vote = 2 if rng.random() < 0.3 else int(y if rng.random() < h else not y)
            code = code * 3 + vote
        counts[code] += 1
        truth[code, y] += 1
    posterior, chance, share = quality_model.fit_labels(counts)
    right = sum(n for (code, y), n in truth.items() if (posterior[code] > 0.5) == y) / 20_000
    assert right > 0.95 and abs(share - 0.7) < 0.03
    for j, h in enumerate(hit):
        assert abs(chance[j, 1, 1] / (chance[j, 1, 0] + chance[j, 1, 1]) - h) < 0.05
    assert quality_model.fit_labels({})[0] == {}


def test_classifier_rows(odd, empty):
    got = quality_model.op1_quality_model(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in odd.collect())
    assert all(not r["kept"] and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert quality_model.op1_quality_model(empty).count() == 0
    kept = quality_model.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in got)


def test_classifier_agrees_with_itself_over_partitions(larger):
    a = {r["doc_id"]: r["kept"] for r in quality_model.op1_quality_model(larger).collect()}
    b = {r["doc_id"]: r["kept"] for r in quality_model.op1_quality_model(larger.repartition(7)).collect()}
    assert a == b


def test_stages(spark, sf, docs):
    columns = docs.columns
    now, rows = docs, docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = saved(stage(spark, now, sf), name)
        got = made.collect()
        assert made.columns == columns
        if name == "quality":
            judged = {r["doc_id"]: r["kept"] for r in quality_model.op1_quality_model(now).collect()}
            assert Counter(map(tuple, got)) == Counter(tuple(r) for r in rows if judged[r["doc_id"]])
        if name == "near_copies":
            group = {r["doc_id"]: r["component_id"] for r in partenum.op7_partenum(now).collect()}
            assert Counter(map(tuple, got)) == Counter(tuple(r) for r in rows if group[r["doc_id"]] == r["doc_id"])
        if name == "secrets":
            path = path_of(secret_scan.DEFAULT_VOCABULARY)
            before = {r["doc_id"]: r for r in rows}
            assert len(got) == len(rows)
            for r in got:
                old = before[r["doc_id"]]
                spans = secret_scan.scan_text(old["text"], path)
                assert (r["text"] == old["text"]) == (not spans)
                assert not spans or r["n_chars"] == len(r["text"]) and all(old["text"][a:b] not in r["text"] for _, a, b in spans)
        if name == "mix":
            want = Counter()
            for r in mixing.mix_sources(now).collect():
                want[r["doc_id"]] += r["taken"]
            taken = Counter()
            for r in got:
                taken[r["doc_id"]] += len(mixing.WORD.findall(r["text"]))
            assert taken == +want
        now, rows = made, got
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert sum(r["length"] for r in pieces.collect()) > 0


def test_pipeline_runs_and_stages_take_odd_rows(spark, sf, odd, empty):
    assert corpus_pipeline.run(spark, sf).count() > 0
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, odd, sf)
        assert name == "pack" or made.columns == odd.columns
        made.collect()
        assert stage(spark, empty, sf).count() == 0


def test_drop_copies_of_repeated_rows(odd):
    got = Counter(r["doc_id"] for r in partenum.drop_copies(odd).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, None: 1, 7: 1, 8: 1}


def test_stages_take_columns_named_like_their_own(odd):
    """Copies and the mix work beside columns of their internal names."""
    from lodegraph.llm import mixing, partenum
    from pyspark.sql import functions as F

    clash = odd.withColumns({n: F.lit(1) for n in ("_row_key", "_again", "_key", "_taken", "_size", "key", "sig", "component", "range", "target")})
    assert partenum.drop_copies(clash).columns == clash.columns and mixing.mixed_documents(clash).columns == clash.columns
    assert partenum.drop_copies(clash).count() == partenum.drop_copies(odd).count()
    assert mixing.mixed_documents(clash).count() == mixing.mixed_documents(odd).count()
