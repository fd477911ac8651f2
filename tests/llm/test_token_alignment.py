"""Operator 13 against brute force: both tokenizers over whole texts, all pairs of tokens that overlap."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest
from lodegraph.llm import token_alignment
from lodegraph.llm.vocab import path_of


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_of("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=path_of("piece_bpe_32k.model"))


def byte_alphabet():
    """The characters that stand for bytes in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in kept)}


ALPHABET = byte_alphabet()


def sides(text, coders):
    a, b = coders
    ids_a = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(ALPHABET[c] for c in t)) for i, t in zip(ids_a.ids, ids_a.tokens)]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return None
    out = []
    for side in (left, right):
        at, spans = 0, []
        for i, data in side:
            spans.append((i, at, at + len(data)))
            at += len(data)
        out.append(spans)
    return out


def brute(rows, coders):
    linked, found = [], []
    for r in rows:
        both = sides(r["text"], coders) if r["text"] else None
        a, b = both or ([], [])
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        parts = [[[] for _ in cuts] for _ in range(2)]
        for part, side in zip(parts, (a, b)):
            for i, _, e in side:
                part[bisect_left(cuts, e)].append(str(i))
        groups = ["|".join(map(",".join, both_sides)) for both_sides in zip(*parts)]
        links, k = [], 0
        for i, s, e in a:
            while b[k][2] <= s:
                k += 1
            j = k
            while j < len(b) and b[j][1] < e:
                links.append((i, b[j][0]))
                j += 1
        linked.append(links)
        found.append((r["doc_id"], len(a), len(b), len(cuts), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(p for links in linked for p in set(links))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return Counter((*f[:5], sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), f[5]) for f, links in zip(found, linked))


HARD = ["a  b", " leading", "trailing ", "\n\nlines \n\n of\tcells\n", "it's o'clock'll", "<|endoftext|> is <s> plain </s> <unk> <0x41>", "mark ▁ here", "▁", "é" * 700, "1234567 89 3.14159", "日本語 のテキスト 😀👩‍👩‍👧 z",
        "\x00\x01 nul", "x\x1cy \x85 z\xa0w", "aaaa" * 300, "=" * 400, " ", "\t", "﻿bom", "ﬁne ligature ½", "é combining", "a 　 wide", "one", "don't 'll 've' s", "<0x0A> \n"]


@pytest.mark.parametrize("which,chars", [("docs", 1 << 25), ("docs", 20_000), ("odd", 3_000)])
def test_equals_brute_force(spark, coders, which, chars, request):
    docs = request.getfixturevalue(which)
    if which == "odd":
        docs = docs.unionByName(spark.createDataFrame([(100 + i, t, "en", "s", 1, 2) for i, t in enumerate(HARD + HARD[:5])], docs.schema))
    got = token_alignment.align(docs, block_chars=chars, most_shipped=0 if chars == 3_000 else 1 << 20).documents.collect()
    assert Counter(map(tuple, got)) == brute(docs.select("doc_id", "text").collect(), coders)


def test_pairs_are_counted_over_all_documents(spark, coders, odd):
    docs = odd.where("length(text) < 1000")
    got = {(r["a"], r["b"]): r["n_docs"] for r in token_alignment.align(docs, block_chars=50).pairs.collect()}
    want = Counter()
    for r in docs.collect():
        if r["text"] and (both := sides(r["text"], coders)):
            want.update({(i, j) for i, s, e in both[0] for j, t, f in both[1] if s < f and t < e})  # short texts only
    assert got == want


def test_empty_table_and_clashing_columns(spark, docs, empty):
    assert token_alignment.op13_token_alignment(empty).count() == 0
    clash = docs.selectExpr("*", "1 AS block", "2 AS row", "3 AS kind", "4 AS tokens", "5 AS n", "6 AS n_a")
    assert clash.count() == token_alignment.op13_token_alignment(clash).count()


def test_segments_of_several_runs_and_a_lean_plan(spark, coders, empty):
    rows = [(1, "é" * 12_000 + " end"), (2, "x-" * 30_000), (3, "left ▁ out " + "y" * 20_000), (4, " " + "word's " * 5_000), (5, "word's")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = token_alignment.align(docs, block_chars=100_000)
    assert Counter(map(tuple, found.documents.collect())) == brute(docs.collect(), coders)
    paths = path_of("byte_bpe_50k.tiktoken"), path_of("piece_bpe_32k.model")
    runs = token_alignment.segments(docs, "text", *paths, 100_000)
    assert {r["base"] for r in runs.collect()} == {0, 1, 2, 3}
    plan = token_alignment.segment_links(runs, token_alignment.id_bits(*paths))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and not any(x in plan for x in ("Join", "collect_list"))
