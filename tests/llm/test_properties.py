"""Properties of the pure parts, on generated inputs."""

from __future__ import annotations

import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from lodegraph.llm import mixing, packing, partenum, pseudonyms, quality_model, secret_scan, warc
from lodegraph.llm.vocab import path_of

few = settings(max_examples=60, deadline=None)


@few
@given(st.lists(st.integers(1, 3000), max_size=40), st.integers(1, 8))
def test_packer(lengths, most_open):
    p = packing.Packer(0, most_open=most_open)
    docs = [np.arange(n, dtype="<u4") + i for i, n in enumerate(lengths)]
    for i, ids in enumerate(docs):
        p.add(i, ids)
    p.end()
    covered = [np.zeros(n, int) for n in lengths]
    windows: dict[int, list] = {}
    for doc, start, length, crc, total, seq, offset, tier, _ in p.drain():
        covered[doc][start : start + length] += 1
        assert total == lengths[doc] and crc == zlib.crc32(docs[doc][start : start + length].tobytes())
        windows.setdefault(seq, []).append((offset, length, tier))
    assert all((c == 1).all() for c in covered)
    short = 0
    for pieces in windows.values():
        at = 0
        for offset, length, tier in sorted(pieces):
            assert offset == at
            at += length
        assert at <= tier
        short += at < tier
    assert short <= 1


@few
@given(st.integers(0, 10**19), st.integers(1, 10**19), st.binary(min_size=1, max_size=16))
def test_permute_turns_back(value, size, key):
    value %= size
    new = pseudonyms.permute(value, size, key, "t")
    assert 0 <= new < size and pseudonyms.permute(new, size, key, "t", back=True) == value


@few
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111 1111 1111", "2020-02-29", "31.12.1999", "10.1.2.3", "a.B9@x.com", "+1 (017) 555-7713", "123-45-6789", "GB82WEST12345698765432", "1.2", "x", "\n", "é", "12"]), max_size=12))
def test_pseudonyms_turn_back(parts):
    text = "; ".join(parts)  # set apart, as neighbouring digits may read as one number
    new, spans = pseudonyms.Pseudonymiser(b"k").text(text)
    assert pseudonyms.Pseudonymiser(b"k", back=True).text(new)[0] == text
    assert len(new) == len(text) or any(k == "ipv4" for k, _, _ in spans)


@few
@given(st.text(alphabet="abcdef0123456789AKI:= \"'tokensecrpwd_/+.-é", max_size=120))
def test_secret_spans_are_the_base_ones(text):
    found = [s for s in secret_scan.scan_text(text, path_of(secret_scan.DEFAULT_VOCABULARY)) if s[0] != "random"]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    assert sorted(found) == sorted(want)


@few
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=3)), st.integers(0, 10**6), max_size=9))
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert set(got) == set(sizes)
    assert all(0 <= got[s] <= 2 * sizes[s] + 1e-6 for s in sizes)
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-3 * max(1, sum(sizes.values()))


@few
@given(st.text(max_size=400))
def test_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    assert len(partenum.shingle_set(text.encode("utf-8", "surrogatepass"))) == len(want)


@few
@given(st.text(max_size=300))
def test_statistics_never_fail(text):
    stats = quality_model.stats_of(text)
    assert stats.n == len(re.findall(r"[^\x20\x09-\x0D]+", text)) and sum(stats.shapes.values()) == stats.n
    assert 0 <= quality_model.pattern_of(stats) < quality_model.PATTERNS


@few
@given(st.binary(max_size=500), st.one_of(st.none(), st.integers(-(2**62), 2**62)), st.one_of(st.none(), st.text(max_size=30)), st.booleans())
def test_records_read_back(payload, page_id, url, revisit):
    import gzip
    import io

    data = warc.record_bytes(page_id, url, payload, warc.base32_sha1(payload), 5 if revisit else None, revisit)
    ((headers, block),) = warc.parse_records(io.BytesIO(gzip.decompress(data)))
    row = warc._record_row(headers, block, "f")
    assert (row[0], row[2], row[3], row[5], row[6]) == (page_id, "revisit" if revisit else "response", len(payload), 5 if revisit else None, True)


def test_neighbouring_cards():
    made = pseudonyms.Pseudonymiser(b"k")
    for text in ("4111 1111 1111 1111 5500 0000 0000 0004", "4111111111111111 5500000000000004", "4111 1111 1111 1111 123-45-6789"):
        new, spans = made.text(text)
        assert len(spans) == 2 and "1111 1111" not in new and "5500" not in new and "123-45" not in new
