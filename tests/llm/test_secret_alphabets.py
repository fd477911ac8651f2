"""Recall and precision of the token test by alphabet, on planted strings and on joined words."""

from __future__ import annotations

import random
import string

import pytest
from lodegraph.llm import secret_scan
from lodegraph.llm.vocab import path_of

PATH = path_of(secret_scan.DEFAULT_VOCABULARY)
WORDS = """configuration manager service provider internal factory builder request response handler database connection pool timeout index search
vector value account customer order region nation supplier part line item price discount return status delivery quick brown fox jumps over lazy dog""".split()
ALPHABETS = {
    "lower": (string.ascii_lowercase, 0.93), "upper": (string.ascii_uppercase, 0.93), "mixed": (string.ascii_letters, 0.97), "letters and digits": (string.ascii_letters + string.digits, 0.97),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.97), "base64url": (string.ascii_letters + string.digits + "-_", 0.9), "digits": (string.digits, 0.0),
}


def found(run):
    text = f"see {run} there"
    return any(k == "random" for k, _, _ in secret_scan.scan_text(text, PATH))


@pytest.mark.parametrize("name", ALPHABETS)
@pytest.mark.parametrize("length", [20, 32, 40])
def test_recall(name, length):
    alphabet, least = ALPHABETS[name]
    rng = random.Random(length)
    hits = sum(found("".join(rng.choice(alphabet) for _ in range(length))) for _ in range(400))
    assert hits >= least * 400 and (name != "digits" or not hits)


@pytest.mark.parametrize("how", ["lower", "upper", "camel", "snake", "screaming", "kebab", "path"])
def test_precision_on_joined_words(how):
    rng, hits = random.Random(7), 0
    for _ in range(600):
        words = []
        while len("".join(words)) < 20:
            words.append(rng.choice(WORDS))
        join = {"lower": "".join, "upper": lambda w: "".join(w).upper(), "camel": lambda w: "".join(x.capitalize() for x in w), "snake": "_".join, "screaming": lambda w: "_".join(w).upper(), "kebab": "-".join, "path": "/".join}[how]
        hits += found(join(words))
    assert hits <= (0.02 if how == "upper" else 0.005) * 600
