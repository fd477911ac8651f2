"""Cases that the operators once left out."""

from __future__ import annotations

import random
import re
import string
import time

import pytest
from lodegraph.llm import mixing, pseudonyms, secret_scan
from lodegraph.llm.vocab import path_of

PHONES = (
    "+1 (017) 555-7713", "(212) 555-0147", "212-555-0147", "212.555.0147", "212 555 0147", "1-212-555-0147", "+1 212-555-0147", "+12125550147", "2125550147", "+44 20 7946 0958", "+44 (0)20 7946 0958",
    "+49 (30) 123456", "+33 1 23 45 67 89", "01 23 45 67 89", "01.23.45.67.89", "0123456789", "020 7946 0958", "912 345 678", "612 34 56 78", "+34 612 34 56 78", "+351 912 345 678",
)
DATES = ("25/12/2024", "3/7/2024", "12/5/1999", "25/3/2024", "31/1/2001", "2024-3-7", "3.12.2024", "2024/1/31", "12/25/2024", "2024-12-25")


@pytest.mark.parametrize("value", PHONES + DATES)
def test_phones_and_dates_of_all_forms(value):
    kind = "date" if value in DATES else "phone"
    for text in (f"See {value}, please", value, f"({value})", f"Tel.: {value}."):
        new, spans = pseudonyms.Pseudonymiser(b"k").text(text)
        at = text.index(value)
        assert spans == [(kind, at, at + len(value))] and new != text and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", text)
        old, again = pseudonyms.Pseudonymiser(b"k", back=True).text(new)
        assert old == text and [s[0] for s in again] == [s[0] for s in spans]


def test_what_is_neither_phone_nor_date_stays():
    made = pseudonyms.Pseudonymiser(b"k")
    for text in ("1234567890", "32/13/2024", "0/5/2024", "+123", "1700000000", "4111 1111 1111 1112", "123456789", "2024"):
        assert made.text(text) == (text, [])


def test_mixed_values_turn_back():
    pool = [*PHONES, *DATES, "078-05-1120", "4111 1111 1111 1111", "378282246310005", "3782 822463 10005", "192.168.0.1", "a.b@c.org", "GB82 WEST 1234 5698 7654 32", "12", "word"]
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(pool) + rng.choice([", ", "; ", " and ", "\n"]) for _ in range(5))
        new, spans = pseudonyms.Pseudonymiser(b"k").text(text)
        old, again = pseudonyms.Pseudonymiser(b"k", back=True).text(new)
        assert old == text and [s[0] for s in again] == [s[0] for s in spans]


@pytest.mark.parametrize("before", ["", "connection/database/production/", "production_database_connection_", "downloads/documents/public/releases/"])
def test_secrets_joined_to_words(before):
    rng, path = random.Random(1), path_of(secret_scan.DEFAULT_VOCABULARY)
    missed = 0
    for _ in range(200):
        text = f"see {before}{(secret := ''.join(rng.choices(string.ascii_letters + string.digits, k=24)))} there"
        at = text.index(secret)
        missed += not any(k == "random" and a <= at and b >= at + 24 for k, a, b in secret_scan.scan_text(text, path))
    assert missed <= 6


def test_secrets_with_separators_within_and_known_digests():
    path = path_of(secret_scan.DEFAULT_VOCABULARY)
    words = "connection/database/production/management/documents/international/"
    secret = "q7Xb2Lp9/Zt4Vn8Kd+3Rw6Yh1Gf5Jc0Ms/2Qa7"
    assert any(k == "random" and b - a >= 30 for k, a, b in secret_scan.scan_text(words + secret, path))
    digest = words * 3 + "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08"
    assert [s[0] for s in secret_scan.scan_text(digest, path)] == ["hex"]
    assert not secret_scan.scan_text(words + words, path)


def test_mixing_of_many_sources(spark, odd, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "w " * int(rng.paretovariate(0.7) % 400), rng.choice([None, "", "é", "￿", "\U0001f600", *map(str, range(60))])) for i in range(1500)]
    for frame in (spark.createDataFrame(rows, "doc_id long, text string, source string"), odd):
        show = lambda: sorted(map(repr, mixing.mix_sources(frame, rows_per_range=20).collect()))  # noqa: E731, B023
        few = show()
        with monkeypatch.context() as m:
            m.setattr(mixing, "MAX_SOURCES", 3)
            assert show() == few


@pytest.mark.parametrize("before, after", [("pay ", " NOW please"), ("IBAN: ", " THANKS ok"), ("", ""), ("to ", " OR ELSE 12"), ("(", ")")])
@pytest.mark.parametrize("iban", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"])
def test_no_iban_stays_before_capitals(before, after, iban):
    text = f"{before}{iban}{after}"
    new, spans = pseudonyms.Pseudonymiser(b"k").text(text)
    assert iban not in new and new.startswith(before) and new.endswith(after)
    assert ("iban", len(before), len(before) + len(iban)) in spans
    assert pseudonyms.Pseudonymiser(b"k", back=True).text(new)[0] == text


def test_addresses_in_other_cases_stay_linked_and_long_runs_are_read_in_linear_time():
    made = pseudonyms.Pseudonymiser(b"k")
    lower, upper = made.text("bob7@x.org")[0], made.text("Bob7@x.org")[0]
    assert lower == upper.lower() and lower != "bob7@x.org"
    start = time.perf_counter()
    for run in ("a" * 1_000_000 + "1", "1" * 1_000_000, "a." * 500_000 + "9", "A1 " * 300_000):
        made.text(run)
    assert time.perf_counter() - start < 8


def test_short_keys_and_letters_alone():
    path = path_of("byte_bpe_50k.tiktoken")
    assert ("random", 4, 21) in secret_scan.scan_text("key q8Zk2LmV0xTb7RwYc end", path, min_length=12)
    assert [s[0] for s in secret_scan.scan_text("use wJalrXUtnFEMIKMDENGbPxRfiCYzQWERTKEYq now", path)] == ["random"]
    assert not secret_scan.scan_text("DatabaseConnectionManagerFactory AbstractRequestHandlerBuilder internationalization", path)


def test_token_efficiency_on_generated_strings():
    """Recall on keys and precision on identifiers and paths, by length."""
    rng, path = random.Random(4), path_of("byte_bpe_50k.tiktoken")
    words = "connection database production user account file parser token session manager server client request handler async buffer config release document public update".split()
    hit = lambda s: any(k == "random" for k, _, _ in secret_scan.scan_text(f"see {s} there", path))
    for n in (20, 24, 32, 40):
        keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=n)) for _ in range(200)]
        assert sum(map(hit, keys)) >= 0.97 * 200, n
    plain = ["_".join(rng.choices(words, k=4)) for _ in range(200)] + ["".join(w.capitalize() for w in rng.choices(words, k=4)) + "2" for _ in range(200)]
    plain += ["/".join(rng.choices(words, k=5)) + "/v2" for _ in range(200)]
    assert sum(map(hit, plain)) <= 0.01 * len(plain)
