"""Secret scans: patterns, plus a token-efficiency test that exposes random strings.

A random string has few characters per token under a subword vocabulary, ordinary words and identifiers have many.
``scan_text`` finds, per kind and leftmost without overlap,

* ``assign``, ``access`` and ``hex``: the base patterns; matches that are too short are dropped;
* ``random``: runs of at least ``min_length`` key characters with letters and digits whose characters per token are at
  most ``max_ratio``, unless they are known digests (hex runs of a digest's length, as such the ``hex`` kind has them),
  UUIDs, or words joined by ``-``, ``_``, ``=``, ``+`` or ``/`` of which each is plain letters or plain digits; and runs of
  letters alone of at most the ratio of their cases. Runs of digits alone are identifiers. Of a run that is
  not random as a whole, the parts between separators that are, and else the parts that random windows of tokens of
  ``min_length`` characters reach into, digests and UUIDs left out.

``secret_scan(docs, vocabulary)`` returns one row per input row: doc_id, the kinds' counts, and ``spans``, an array of
(kind, start, end) in code points with an exclusive end, by start and then kind in the order above.

Defined results: a null or empty text has no spans; repeated rows are scanned one by one; extra columns are ignored; an
empty table gives an empty result; a null doc_id stays null. A text is scanned whole in time linear in its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches
from .vocab import encoding, path_of

#: The base patterns and the least lengths of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8

KINDS = ("assign", "access", "hex", "random")
#: Lengths in hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
PARTS = re.compile(r"[-_/=+]")
PART = re.compile(r"[^-_/=+]+")
#: A UUID or a part of hex digits within a run.
KNOWN = re.compile(rf"(?<![A-Za-z0-9])(?:{UUID.pattern}|[0-9a-f]+|[0-9A-F]+)(?![A-Za-z0-9])")

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
MIN_LENGTH = 20
MAX_RATIO = 2.2
#: Of letters alone, by their cases. Generated strings of 20 letters have at most 2.0 (small), 1.82 (capital) and 1.7 (both) characters
#: a token in 97 of 100 cases, fewer where they are longer; joined small words have 2.4 and more, joined capitals 1.9 in 99 of 100 cases.
LOWER_RATIO, UPPER_RATIO, LETTERS_RATIO = 2.0, 1.82, 1.9

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, spans array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@cache
def candidate(min_length: int) -> re.Pattern:
    return re.compile(rf"[A-Za-z0-9+/_=-]{{{max(1, min_length)},}}")


def random_letters(run: str, path: str) -> bool:
    """Whether a run of letters has few characters per token for its cases; a first capital does not count."""
    if not run.isalpha():
        return False
    most = UPPER_RATIO if run.isupper() else LOWER_RATIO if run[1:].islower() else LETTERS_RATIO
    return len(run) <= most * len(encoding(path).encode_ordinary(run))


def is_excluded(run: str) -> bool:
    """Known digests and identifiers."""
    if ALL_HEX.fullmatch(run) and len(run) in DIGEST_LENGTHS or UUID.fullmatch(run):
        return True
    return all(not p or p.isalpha() or p.isdigit() for p in PARTS.split(run))


def is_random(run: str, path: str, max_ratio: float) -> bool:
    if random_letters(run, path):
        return True
    if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)) or is_excluded(run):
        return False
    return len(run) <= max_ratio * len(encoding(path).encode_ordinary(run))


def random_parts(run: str, path: str, min_length: int, max_ratio: float) -> list[tuple[int, int]]:
    """Spans of a run that are random though the run as a whole may not be; time linear in its length."""
    if is_random(run, path, max_ratio):
        return [(0, len(run))]
    letters = [m.span() for m in PART.finditer(run) if m.end() - m.start() >= min_length and random_letters(m[0], path)]
    if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)) or is_excluded(run):
        return letters
    out, at = [], 0
    known = [m.span() for m in KNOWN.finditer(run) if "-" in m[0] or len(m[0]) in DIGEST_LENGTHS]
    for start, end in [*known, (len(run), len(run))]:
        if start - at >= min_length:
            out += _random_in(run, at, start, path, min_length, max_ratio)
        at = end
    return out


def _random_in(run: str, begin: int, stop: int, path: str, min_length: int, max_ratio: float) -> list[tuple[int, int]]:
    found = []
    parts = [(m.start() + begin, m.end() + begin) for m in PART.finditer(run[begin:stop])]
    for start, end in parts:
        if end - start >= min_length and is_random(run[start:end], path, max_ratio):
            found.append((start, end))
    coder, ends, windows = encoding(path), [begin], []
    for token in coder.encode_ordinary(run[begin:stop]):
        ends.append(ends[-1] + len(coder.decode_single_token_bytes(token)))
    last = 0
    for first in range(len(ends) - 1):  # windows of whole tokens, as short as min_length allows
        while last < len(ends) - 1 and ends[last] - ends[first] < min_length:
            last += 1
        start, end = ends[first], ends[last]
        if end - start < min_length:
            break
        if end - start <= max_ratio * (last - first) and _mixed(run[start:end]):
            windows.append((start, end))
    k = 0
    for start, end in windows:
        while k < len(parts) and parts[k][1] <= start:
            k += 1
        reached = k
        while reached + 1 < len(parts) and parts[reached + 1][0] < end:
            reached += 1
        found.append((parts[k][0], parts[reached][1]))
    merged: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((start, end))
    return merged


def _mixed(window: str) -> bool:
    """Whether most of a window is in parts of both letters and digits."""
    return 2 * sum(len(p) for p in PARTS.split(window) if p and not p.isalpha() and not p.isdigit()) > len(window)


def scan_text(text: str | None, path: str, min_length: int = MIN_LENGTH, max_ratio: float = MAX_RATIO) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span."""
    if not text:
        return []
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in candidate(min_length).finditer(text):
        found += [(m.start() + a, 3, m.start() + b) for a, b in random_parts(m[0], path, min_length, max_ratio)]
    return [(KINDS[k], start, end) for start, k, end in sorted(found)]


def secret_scan(docs: DataFrame, vocabulary: str | None = None, min_length: int = MIN_LENGTH, max_ratio: float = MAX_RATIO, text_col: str = "text") -> DataFrame:
    """Spans of secrets in each document; ``vocabulary``: path of a file of tiktoken ranks that every executor can read."""
    path = vocabulary or path_of(DEFAULT_VOCABULARY)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [scan_text(t, path, min_length, max_ratio) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in x) for x in spans], pa.int64()) for k in KINDS]
            rows = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in spans], _SPANS)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *counts, rows], names=["doc_id", *(f"n_{k}" for k in KINDS), "spans"])

    return map_batches(docs.select("doc_id", text_col), scan, SCHEMA)


def redact(docs: DataFrame, vocabulary: str | None = None, min_length: int = MIN_LENGTH, max_ratio: float = MAX_RATIO, text_col: str = "text") -> DataFrame:
    """All rows and columns, with ``[kind]`` in place of each span (of overlapping ones the first) and n_chars as it then is."""
    path = vocabulary or path_of(DEFAULT_VOCABULARY)
    names = docs.columns
    at, count_at = names.index(text_col), names.index("n_chars") if "n_chars" in names else None

    def clean(text: str | None) -> str | None:
        out, done = [], 0
        for kind, start, end in scan_text(text, path, min_length, max_ratio):
            if start >= done:
                out += [text[done:start], f"[{kind}]"]
            done = max(done, end)
        return "".join([*out, text[done:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            old = batch.column(at).to_pylist()
            new = [clean(t) for t in old]
            columns[at] = pa.array(new, pa.string())
            if count_at is not None:
                kept = batch.column(count_at).to_pylist()
                columns[count_at] = pa.array([len(n) if n != o else k for o, n, k in zip(old, new, kept)], batch.column(count_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(docs, run, docs.schema)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    """Of the spans that the base patterns found."""
    return hashlib.sha256(joined([s for s in spans if s[0] != "random"]).encode()).hexdigest()


def op6_secret_scan(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    def line(keep_random: bool):
        spans = F.col("spans") if keep_random else F.filter("spans", lambda s: s["kind"] != "random")
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return secret_scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(line(False), 256).alias("base_sha256"), line(True).alias("spans"))
