"""Operators 2, 3, 4, 6, 9 and 10 against brute force, round trips and odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from lodegraph.llm import chat_format, mixing, packing, pseudonyms, quality_rules, secret_scan
from lodegraph.llm.vocab import path_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts_of(text):
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality_rules_counts(which, request):
    frame = request.getfixturevalue(which)
    want = Counter()
    for r in frame.collect():
        n, chars, symbols, dup, rep = counts_of(r["text"])
        want[(r["doc_id"], n, chars, symbols, dup, rep, n < 10 or 100 * rep > 20 * n)] += 1
    got = quality_rules.op9_quality_rules(frame).collect()
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r["base_failed"] and r["kept"] for r in got)


def test_quality_rules_is_native(docs):
    plan = quality_rules.op9_quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing_meets_budgets(which, request):
    frame = request.getfixturevalue(which)
    got = mixing.mix_sources(frame, rows_per_range=7).collect()
    size = {id(r): len(WORD.findall(r["text"] or "")) for r in frame.collect()}
    assert sorted(r["size"] for r in got) == sorted(size.values())
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = mixing.targets({s: sum(r["size"] for r in rows) for s, rows in by.items()})
    assert sum(want.values()) == pytest.approx(1.5 * sum(size.values()))
    for s, rows in by.items():
        assert rows[0]["target"] == pytest.approx(want[s])
        assert sum(r["taken"] for r in rows) == int(want[s] + 1e-9)
        at = 0
        for r in sorted(rows, key=lambda r: (r["words_before"], r["size"] > 0)):
            assert r["words_before"] == at
            at += r["size"]
    again = mixing.mix_sources(frame.repartition(5), rows_per_range=7).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_targets_water_filling():
    # weights 3, 1, 2: a is cut at 2 x 10, what it leaves goes to b and c
    assert mixing.targets({"c": 100, "a": 10, "b": 100}) == {"a": 20.0, "b": pytest.approx(295 / 3), "c": pytest.approx(590 / 3)}
    assert mixing.targets({}) == {} and mixing.targets({None: 0}) == {None: 0.0}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing_covers_every_id_once(which, request):
    import public_tokenizers
    from tokenizers import Tokenizer

    frame = request.getfixturevalue(which)
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in frame.collect():
        want[(r["doc_id"], np.array([*reference.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes())] += 1
    texts = defaultdict(list)
    for doc_id, ids in want:
        texts[doc_id].append(ids)
    got = packing.op3_packing(frame).collect()
    covered = Counter()
    for r in got:
        covered[(r["doc_id"], r["doc_tokens"])] += r["length"]
        assert any(zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] and len(ids) == 4 * r["doc_tokens"] for ids in texts[r["doc_id"]])
    assert covered == sum((Counter({(d, len(ids) // 4): n * len(ids) // 4}) for (d, ids), n in want.items()), Counter())
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 1024 * frame.rdd.getNumPartitions()


def test_tokenizer_agrees_on_special_strings():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("a<|endoftext|>b", " <|endoftext|> ", "<|endoftext|>", "it's 1234\n\n  x é😀 \x1c", "don't  <|end"):
        assert packing.tokenizer()(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_packer_without_short_rests():
    p = packing.Packer(0, most_open=2)
    for d in range(20):
        p.add(d, np.arange(900, dtype="<u4"))
    p.end()
    rows = p.drain()
    assert sum(r[2] for r in rows) == 20 * 900
    assert len({(r[0], r[1] + i) for r in rows for i in range(r[2])}) == 20 * 900


def test_packer_balances_steps_and_cuts_few_documents():
    rng = np.random.default_rng(5)
    lengths = np.minimum(5000, rng.lognormal(5.5, 1.0, 3000).astype(int) + 1)
    p = packing.Packer(0)
    rows = []
    for d, n in enumerate(lengths):
        p.add(d, np.zeros(n, dtype="<u4"))
        assert p.held <= packing.MOST_OPEN and len(p.steps) <= len(packing.TIERS)
    p.end()
    rows = p.drain()
    work = Counter()
    for tier, group in {r[5]: (r[7], r[8]) for r in rows}.values():
        work[group] += tier
    assert sum(w != packing.STEP_TOKENS for w in work.values()) <= 1
    assert {r[7] for r in rows} == set(packing.TIERS)
    whole = Counter(r[0] for r in rows)
    short = [d for d, n in enumerate(lengths) if n < 1024]
    assert np.mean([whole[d] == 1 for d in short]) > 0.6


def base_spans(text):
    out = []
    for kind, pattern, ok in (
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ):
        out += [(m.start(), ("assign", "access", "hex").index(kind), m.end(), kind) for m in pattern.finditer(text) if ok(m)]
    return [(k, a, b) for a, _, b, k in sorted(out)]


TRICKY = [
    "token: token: abcdefgh", "token=secret=abcdefgh12", "AKIAAKIA12345678 AKIA123", "API_KEY = 'abcdefgh' apikey:\"x\"", "é password : 12345678",
    "a" * 31 + "g" + "a" * 32, "paſſword=12345678", "key Zq8fK2xW9vLp3nTr7bYd1mHs5cJg", "550e8400-e29b-41d4-a716-446655440000", "a-long-name-of-words-2024",
]


def test_secret_scan_base(docs, odd):
    path = path_of(secret_scan.DEFAULT_VOCABULARY)
    for text in [*TRICKY, *(r["text"] for r in docs.collect()), *(r["text"] for r in odd.collect())]:
        assert [s for s in secret_scan.scan_text(text, path) if s[0] != "random"] == base_spans(text or "")


def test_secret_scan_random_strings():
    path = path_of(secret_scan.DEFAULT_VOCABULARY)
    kinds = lambda t: [s[0] for s in secret_scan.scan_text(t, path)]
    assert kinds(TRICKY[7]) == ["random"]
    assert kinds(TRICKY[8]) == [] and kinds(TRICKY[9]) == []
    assert kinds("0123456789abcdef0123456789abcdef") == ["hex"]


def test_secret_scan_rows(odd, spark):
    frame = odd.union(spark.createDataFrame([(20 + i, t, None, None, None, None) for i, t in enumerate(TRICKY)], odd.schema))
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secret_scan.op6_secret_scan(frame).collect())
    want = Counter()
    for r in frame.collect():
        spans = base_spans(r["text"] or "")
        n = Counter(k for k, _, _ in spans)
        want[(r["doc_id"], n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())] += 1
    assert got == want


PII = "card 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112; on 2021-02-28 not 2021-02-30, 03/04/1999, 31.12.2001; ip 10.0.0.255 not 10.0.0.256; ssn 123-45-6789 not 000-45-6789; +1 (017) 555-7713; a.b-7@mail7.example.com; GB82 WEST 1234 5698 7654 32"


def test_pseudonyms_keep_format_and_turn_back():
    made, back = pseudonyms.Pseudonymiser(b"k"), pseudonyms.Pseudonymiser(b"k", back=True)
    new, spans = made.text(PII)
    assert Counter(k for k, _, _ in spans) == {"card": 2, "date": 3, "ipv4": 1, "ssn": 1, "phone": 1, "email": 1, "iban": 1}
    assert back.text(new)[0] == PII and len(new) != 0
    for kept in ("4111111111111112", "2021-02-30", "10.0.0.256", "000-45-6789", "@mail7.example.com"):
        assert kept in new
    for gone in ("4111 1111 1111 1111", "4111111111111111", "2021-02-28", "10.0.0.255", "123-45-6789", "555-7713", "a.b-7@"):
        assert gone not in new
    cards = re.findall(r"card ([\d ]{19}) or (\d{16})", new)[0]
    assert cards[0].replace(" ", "") == cards[1] and pseudonyms.luhn_sum(cards[1]) % 10 == 0


def test_permute_is_a_permutation():
    for size in (1, 2, 3, 10, 97, 1000):
        image = [pseudonyms.permute(v, size, b"k", "t") for v in range(size)]
        assert sorted(image) == list(range(size))
        assert [pseudonyms.permute(v, size, b"k", "t", back=True) for v in image] == list(range(size))


def test_pseudonyms_rows(docs, odd):
    for frame in (docs, odd):
        new = pseudonyms.op4_pseudonyms(frame)
        assert Counter(r["doc_id"] for r in new.collect()) == Counter(r["doc_id"] for r in frame.collect())
        old = pseudonyms.pseudonymise(new, back=True)
        assert Counter((r["doc_id"], r["text"]) for r in old.collect()) == Counter((r["doc_id"], r["text"]) for r in frame.collect())


TURNS = [
    (1, 0, "user", "a", "x"), (1, 1, "bot", "b", "x"), (2, 0, "user", "a", "x"), (2, 1, "bot", "b", "x"), (2, 2, "user", "c", "x"),
    (3, 5, "user", "a", "x"), (3, 9, "bot", "b", "x"), (3, 10, "user", "c", "x"), (4, 0, "user", "a", "x"), (4, 0, "user", "a", "x"),
    (5, None, None, None, "x"), (6, 0, None, "", "x"), (None, 0, "user", "z", "x"), (None, 700, "bot", "z", "x"), (7, 0, "user", "z", "x"), (8, 0, "user", "ba", "x"),
]


def test_chat_format(spark):
    frame = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string, position string")
    got = chat_format.chat_format(frame).collect()
    convs = defaultdict(list)
    for c, *rest in TURNS:
        convs[c].append(rest)
    key = lambda r: tuple((v is not None, v if v is not None else 0) if i == 0 else (v is not None, v or "") for i, v in enumerate(r[:3]))
    seq = {c: [tuple(t[1:3]) for t in sorted(rows, key=key)] for c, rows in convs.items()}
    keep = set()
    for c, s in seq.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in seq.values())
        twin = any(o == s and d is not None and (c is None or d < c) for d, o in seq.items() if d != c)
        if not longer and not twin:
            keep.add(c)
    assert {r["conv_id"] for r in got} == keep
    for c in keep:
        text = "".join(r["rendered"] for r in sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["position"]))
        assert text == "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in seq[c])
    assert chat_format.chat_format(frame.limit(0)).count() == 0


def test_empty_tables(empty):
    for op in (mixing.op2_mixing, packing.op3_packing, pseudonyms.op4_pseudonyms, secret_scan.op6_secret_scan, quality_rules.op9_quality_rules):
        assert op(empty).count() == 0
