"""Operators 5, 7 and 8 against brute force and round trips."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from lodegraph.llm import partenum, warc, weighted_sampling
from lodegraph.llm.bitmap import maybe_in
from lodegraph.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_counts(text):
    words = WORD.findall(lower(text))
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def components_of(rows):
    """Brute force over all pairs of (doc_id, text)."""
    sets = [set(shingle_counts(t)) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 80 * max(len(sets[i]), len(sets[j])) <= 100 * len(sets[i]) + 20 * len(sets[j]) + 80 * len(sets[j]):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * len(sets[i] | sets[j]):
                    group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_jaccard_join_on_tables(which, request):
    frame = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert Counter(map(tuple, partenum.op7_partenum(frame).collect())) == components_of(rows)


def edited(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**9)}"
    return out


def test_jaccard_join_at_the_threshold(spark):
    """Edits of all sizes around the threshold, hot passages, chains and large groups."""
    rng = random.Random(5)
    passage = [f"hot{i}" for i in range(40)]
    rows = []
    for size in (4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 45, 60, 100, 180, 300):
        for _ in range(4):
            words = [f"w{rng.randrange(10**9)}" for _ in range(size)]
            rows.append(words)
            for cut in range(1, min(6, size)):
                rows.append(words[cut:])
            for n in (1, 2, 3, size // 40 + 1):
                rows.append(edited(words, min(n, size), rng))
    for _ in range(60):
        rows.append(passage + [f"o{rng.randrange(10**9)}" for _ in range(rng.randrange(5, 60))])
    chain = [f"c{i}" for i in range(200)]
    rows += [chain[i : i + 60] for i in range(0, 120, 4)]
    base = [f"b{i}" for i in range(150)]
    rows += [edited(base, rng.randrange(0, 7), rng) for _ in range(80)]
    rows += [base] * 30
    rng.shuffle(rows)
    table = [(i + 10, " ".join(w)) for i, w in enumerate(rows)]
    got = Counter(map(tuple, partenum.op7_partenum(spark.createDataFrame(table, DOCS).repartition(4)).collect()))
    assert got == components_of(table)


def test_large_groups_go_in_blocks(spark, monkeypatch):
    """With tiny blocks the pairs across blocks find what one block would."""
    monkeypatch.setattr(partenum, "BLOCK_CLASSES", 7)
    rng = random.Random(9)
    rows = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(120)]
        rows += [edited(base, rng.randrange(0, 9), rng) for _ in range(40)]
    table = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = Counter(map(tuple, partenum.op7_partenum(spark.createDataFrame(table, DOCS)).collect()))
    assert got == components_of(table)


def test_linking_pairs_join_what_links():
    rng = np.random.default_rng(4)
    sets = []
    for size in (1, 5, 6, 9, 40, 300):
        base = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        for cut in range(0, min(size, 30)):
            sets.append(np.unique(np.concatenate([base[cut:], rng.integers(0, 1 << 64, cut // 2, dtype=np.uint64)])))
    pairs = partenum.linking_pairs(sets, list(range(len(sets))), [0] * len(sets))
    assert all(partenum.links(sets[i], sets[j]) for i, j in pairs)
    group = list(range(len(sets)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in pairs:
        group[root(i)] = root(j)
    assert all(root(i) == root(j) for i in range(len(sets)) for j in range(i) if partenum.links(sets[i], sets[j]))


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    frequent = np.zeros(1 << 10, bool)
    frequent[rng.integers(0, 1 << 10, 200)] = True
    for size in [*range(1, 40), 70, 150, 400]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            for d in range(0, size // 5 + 2):
                for extra in (0, d // 2, d):
                    b = np.unique(np.concatenate([a[d - extra :], rng.integers(0, 1 << 64, extra, dtype=np.uint64)]))
                    if partenum.links(a, b) and not np.array_equal(a, b):
                        assert set(partenum.signatures(a, frequent)) & set(partenum.signatures(b, frequent)), (size, d, extra)


def test_signatures_of_texts_that_share_a_passage_seldom_meet():
    """Each signature is a subset of two parts: sets that share a seventh of their shingles seldom have one in common."""
    rng = np.random.default_rng(5)
    frequent = np.zeros(1 << 10, bool)
    new = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    passage = new(46)
    signed = [set(partenum.signatures(np.unique(np.concatenate([passage, new(250)])), frequent)) for _ in range(120)]
    met = sum(bool(a & b) for i, a in enumerate(signed) for b in signed[:i])
    assert met < 0.1 * 120 * 119 / 2


def test_jaccard_join_empty(empty):
    assert partenum.op7_partenum(empty).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, **{x: 100 for x in range(100, 140)}, 200: 200, 201: 200}


def test_bitmap(spark):
    keys = spark.createDataFrame([(i * 31,) for i in range(200)], "k long")
    table = spark.range(0, 6200).withColumnRenamed("id", "k")
    got = {r["k"] for r in table.where(maybe_in(keys, "k", 1 << 14)).collect()}
    assert got >= {i * 31 for i in range(200)} and len(got) < 400


def jaccard(a, b):
    a, b = shingle_counts(a), shingle_counts(b)
    return 1.0 if a == b else sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in weighted_sampling.op5_weighted_sampling(docs).collect()}
    assert len(got) == len(rows)
    off_edited, off_next, by_text = [], [], {}
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        third = len(t) // 3
        changed = t[: len(t) - third] + after[:third]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        if sum(shingle_counts(t).values()) > 100:
            off_edited.append(r["near_edited"] - jaccard(t, changed))
            off_next.append(r["near_next"] - jaccard(t, after))
    assert abs(np.mean(off_edited)) < 0.03 and np.std(off_edited) < 0.09 and np.max(np.abs(off_next)) < 0.3


def test_collision_rate_is_the_generalised_jaccard(spark):
    """Within binomial error over many pairs: short texts, repetitive ones, heavy terms and long ones."""
    rng = random.Random(1)
    word = lambda: f"u{rng.randrange(10**9)}"
    kinds = {"short": [], "repetitive": [], "heavy": [], "long": []}
    for _ in range(60):
        base = [word() for _ in range(12)]
        kinds["short"].append((base, base[: rng.randrange(6, 12)] + [word() for _ in range(4)]))
        unit = [word() for _ in range(40)]
        kinds["repetitive"].append((unit * 6, unit * 2 + [word() for _ in range(60)]))
        heavy, light = [word()] * 200, [word() for _ in range(100)]
        kinds["heavy"].append((heavy + light, heavy[: rng.randrange(60, 200)] + [word() for _ in range(50)]))
        long_ = [word() for _ in range(700)]
        kinds["long"].append((long_, long_[:400] + [word() for _ in range(200)]))
    f = weighted_sampling
    for name, pairs in kinds.items():
        texts = [(2 * i + side, " ".join(p[side])) for i, p in enumerate(pairs) for side in (0, 1)]
        got = {r["i"]: r["samples"] for r in f.fingerprints(spark.createDataFrame(texts, "i long, t string"), ["i"], "t").collect()}
        rate = [np.mean(np.array(got[2 * i]) == np.array(got[2 * i + 1])) for i in range(len(pairs))]
        want = [jaccard(" ".join(a), " ".join(b)) for a, b in pairs]
        error = (sum(w * (1 - w) for w in want) / f.SAMPLES) ** 0.5 / len(pairs)  # of the mean, if samples are independent
        assert abs(np.mean(rate) - np.mean(want)) < 4 * error, (name, np.mean(rate), np.mean(want), error)
        assert np.std(np.array(rate) - want) < 1.5 * error * len(pairs) ** 0.5, name


def test_fingerprints_of_odd_rows(odd, empty, spark):
    got = weighted_sampling.op5_weighted_sampling(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in odd.collect())
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["fingerprint"])
    assert by[1] == by[2] == by[3] == {"0" * 8 * weighted_sampling.SAMPLES} and by[5] == by[6] and by[4] != by[1]
    assert weighted_sampling.op5_weighted_sampling(empty).count() == 0
    one = weighted_sampling.op5_weighted_sampling(spark.createDataFrame([(3, "abcdef")], DOCS)).collect()[0]
    assert (one["near_next"], one["edited_sha256"]) == (1.0, hashlib.sha256(b"abcdab").hexdigest())


def test_fingerprints_have_a_small_plan(docs):
    plan = weighted_sampling.op5_weighted_sampling(docs)._jdf.queryExecution()
    assert len(plan.optimizedPlan().toString()) < 60_000 and len(plan.executedPlan().toString()) < 120_000


def test_repeated_terms_keep_or_lower_their_ranks(spark):
    from pyspark.sql import functions as F

    f, words = weighted_sampling, [f"w{i}" for i in range(40)]
    texts = [(n, " ".join(words * n)) for n in (1, 2, 30)] + [(4, "one two"), (5, "")]
    got = {r["i"]: r for r in f.fingerprints(spark.createDataFrame(texts + texts[1:2], "i long, t string"), ["i"], "t").collect()}
    assert [got[i]["n_rows"] for i in (1, 2, 30, 4, 5)] == [1, 2, 1, 1, 1]
    assert all(got[i]["samples"] != [0] * f.SAMPLES for i in (1, 2, 30, 4)) and got[5]["samples"] == [0] * f.SAMPLES
    ranks = {}
    for s in (1, 2, 3, 50):
        found = f._ranked(spark.range(200).select(F.xxhash64("id").alias("_h"), F.lit(s).alias("_s"), (F.col("id") % f.SAMPLES).cast("int").alias("_k")))
        ranks[s] = [(r["_rank"], r["_first"]) for r in found.orderBy("_h").collect()]
    assert all(a == b for a, b in ranks[1]) and all(x[0] >= y[0] for s, t in ((1, 2), (2, 3), (3, 50)) for x, y in zip(ranks[s], ranks[t]))
    assert 0 < sum(x == y for x, y in zip(ranks[1], ranks[2])) < 200


def test_fingerprints_are_native(docs):
    plan = weighted_sampling.op5_weighted_sampling(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


PAGES = "page_id long, url string, html string, sha1 string"


def odd_pages(spark):
    rows = [(1, "http://a/", "same", "x"), (2, None, "same", "x"), (3, "http://c/\r\nX: y", "other é", "x"), (4, "http://d/", None, "x"), (5, "http://e/", "", "x"), (None, "http://n/", "same", "x"), (6, "u", "twice", "x"), (6, "u", "twice", "x"), (7, "big", "z\r\n\r\n" * 200_000, "x"), (None, None, "alone", None)]
    return spark.createDataFrame(rows, PAGES)


def expected_pages(rows, least=0):
    best = defaultdict(lambda: None)
    for r in rows:
        p = (r["html"] or "").encode()
        if r["page_id"] is not None and (best[p] is None or r["page_id"] > best[p]):
            best[p] = r["page_id"]
    want, done = Counter(), set()
    for r in rows:
        p = (r["html"] or "").encode()
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        first = r["page_id"] == best[p] and p not in done
        if first:
            done.add(p)
        revisit = len(p) >= least and not first
        want[(r["page_id"], len(p), digest, "revisit" if revisit else "response", best[p] if revisit else None)] += 1
    return want


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, sf, tmp_path, least):
    for name, pages in (("odd", odd_pages(spark)), ("table", spark.read.parquet(f"{sf}/pages.parquet"))):
        runs = []
        for again in range(2):
            folder = f"file://{tmp_path}/{name}-{again}"
            manifest = warc.write_warc(pages.repartition(3 + again), folder, shard_bytes=40_000, roll_bytes=4_000, least_revisit_bytes=least)
            got = warc.read_warc(manifest, folder).collect()
            assert all(r["digest_ok"] for r in got)
            assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected_pages(pages.collect(), least)
            files = {r["file"]: r for r in manifest.collect()}
            here = tmp_path / f"{name}-{again}"
            assert {p.name for p in here.glob("*.warc.gz")} == set(files) and not list(here.glob(".*.tmp"))
            for p in here.glob("*.warc.gz"):
                assert hashlib.sha256(p.read_bytes()).hexdigest() == files[p.name]["sha256"]
            runs.append({n: r["sha256"] for n, r in files.items()})
        assert runs[0] == runs[1] and len(runs[0]) > 1


def test_shards_of_ids_far_apart(spark):
    ids = [*range(2000), 1 << 60, -(1 << 62)]
    rows = spark.createDataFrame([(i, 100) for i in ids], "page_id long, size long")
    shard, n = warc.shard_plan(rows, 10_000)
    got = Counter(r["s"] for r in rows.select(shard.alias("s")).collect())
    assert n == len(got) and 21 <= n <= 40 and max(got.values()) <= 100


def test_warc_payloads_and_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/one"
    manifest = warc.write_warc(odd_pages(spark), folder)
    (name,) = [r["file"] for r in manifest.collect()]
    with gzip.open(tmp_path / "one" / name) as stream:
        records = list(warc.parse_records(stream))
    assert {b.split(b"\r\n\r\n", 1)[1] for h, b in records if h["WARC-Type"] == "response"} == {b"same", "other é".encode(), b"", b"twice", b"z\r\n\r\n" * 200_000, b"alone"}
    assert json.dumps([h["WARC-Target-URI"] for h, _ in records]).count("\\r") == 0
    nothing = odd_pages(spark).limit(0)
    folder = f"file://{tmp_path}/none"
    assert warc.read_warc(warc.write_warc(nothing, folder), folder).count() == 0


def test_purge_deletes_what_was_written(spark):
    from lodegraph.llm import common

    common._made.clear()
    frame = common.saved(spark.range(3).toDF("x"), "purge-test")
    assert frame.count() == 3 and common.purge(spark) == 1 and common.purge(spark) == 0
