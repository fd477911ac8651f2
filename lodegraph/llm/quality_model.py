"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or not at all on every document. Votes are counted by pattern over all
documents (at most 3 ** 9 patterns, whatever the corpus), and expectation-maximisation on the counts estimates the share
of good documents and each labeller's accuracy on either class (the model of Dawid and Skene). The posterior of a
document's pattern is its soft label. A hashed linear scorer is fitted to the soft labels of a sample of ``fit_rows``
documents, the ones with the smallest hash of id and text, and then scores every document; ``kept`` is a score of
``threshold`` or more.

Features are hashed shares of word shapes, words, ends of words, function words, repeats and variety of the whole text, so
work is linear in it. Words and their ends are content that no labeller looks at: they let the scorer tell texts apart
that the labellers' rules miss. Places are hashed, so a text has at most ``DIMENSIONS`` of them, however long it is.
Defined results: a null text or one without words scores 0 and is not kept; repeated rows are scored one by one; extra
columns are ignored; an empty table gives an empty result; a null doc_id stays null.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, saved
from .quality_rules import STOP_WORDS, SYMBOLS

DIMENSIONS = 1 << 15
#: Weight of content features against the others: one word alone should not decide.
CONTENT = 0.5
#: Bytes of a word's end that are a feature.
END = 3
#: Bound on the sample of labelled rows that the scorer is fitted to.
FIT_ROWS = 4000
THRESHOLD = 0.5
GOOD, BAD, NONE = 1, 0, 2

_STOP = tuple(w.encode() for w in dict.fromkeys(STOP_WORDS))
_SHAPE = bytes(97 if 97 <= b <= 122 or b > 127 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(a)a+|A(A)+|(0)0+")
_SYMBOL = re.compile(rb"[" + re.escape(SYMBOLS.encode()) + rb"]")


@dataclass
class Stats:
    """What labellers and features see of a text."""

    n: int = 0
    shapes: Counter = field(default_factory=Counter)
    share: dict[str, float] = field(default_factory=dict)
    stops: dict[bytes, int] = field(default_factory=dict)
    known: Counter = field(default_factory=Counter)


def stats_of(text: str | None) -> Stats:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return Stats()
    shaped = data.translate(_SHAPE)
    shaped = _RUN.sub(lambda m: m[1] or (m[2] and b"B") or m[3], shaped) if n < 8 else re.sub(rb"0+", b"0", re.sub(rb"AA+", b"B", re.sub(rb"a+", b"a", shaped)))
    shapes = Counter(shaped.split())
    known = Counter(data.lower().split())
    stops = {w: c for w in _STOP if (c := known.get(w))}
    word_bytes = sum(map(len, words))
    word_chars = len(text) - (len(data) - word_bytes)
    of = lambda test: sum(c for s, c in shapes.items() if test(s)) / n
    share = {
        "symbols": of(_SYMBOL.search),
        "bangs": of(lambda s: s.endswith(b"!")),
        "capitals": of(lambda s: b"B" in s),
        "repeats": sum(map(eq, words, words[1:])) / n,
        "stops": sum(stops.values()) / n,
        "variety": len(known) / n,
        "length": word_chars / n,
        "ends": of(lambda s: s[-1:] in b".?"),
        "small": of(lambda s: s[:1] == b"a"),
    }
    return Stats(n, shapes, share, stops, known)


def _vote(good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else NONE


#: The labellers: each sees the statistics of a text that has words.
LABELLERS = {
    "symbols": lambda s: _vote(s.share["symbols"] == 0, s.share["symbols"] > 0.03),
    "bangs": lambda s: _vote(s.share["bangs"] == 0, s.share["bangs"] > 0.05),
    "capitals": lambda s: _vote(s.share["capitals"] < 0.05, s.share["capitals"] > 0.15 and s.n >= 3),
    "repeats": lambda s: _vote(s.share["repeats"] < 0.04, s.share["repeats"] > 0.1 and s.n >= 8),
    "stops": lambda s: _vote(s.share["stops"] > 0.12, s.share["stops"] < 0.05 and s.n >= 20),
    "variety": lambda s: _vote(s.share["variety"] > 0.5, s.share["variety"] < 0.3 and s.n >= 30),
    "length": lambda s: _vote(3.5 <= s.share["length"] <= 6.2 and s.n >= 10, (s.share["length"] < 3 or s.share["length"] > 6.8) and s.n >= 10),
    "ends": lambda s: _vote(s.share["ends"] >= 0.02, s.share["ends"] < 0.01 and s.n >= 20),
    "small": lambda s: _vote(s.share["small"] > 0.75, s.share["small"] < 0.4 and s.n >= 10),
}
#: Number of vote patterns; the pattern of no vote at all stands for texts without words too.
PATTERNS = 3 ** len(LABELLERS)


def pattern_of(stats: Stats) -> int:
    out = 0
    for vote in LABELLERS.values():
        out = out * 3 + (vote(stats) if stats.n else NONE)
    return out


def votes_of(pattern: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        pattern, vote = divmod(pattern, 3)
        out.append(vote)
    return out[::-1]


def fit_labels(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of good by pattern, P(vote | class, a vote) as [labeller, class, vote], and the share of good documents."""
    patterns = sorted(counts)
    votes = np.array([votes_of(p) for p in patterns], dtype=np.int64).reshape(-1, len(LABELLERS))
    weight = np.array([counts[p] for p in patterns], dtype=float)
    for_, against = (votes == GOOD).sum(1), (votes == BAD).sum(1)
    good = (for_ + 1.0) / (for_ + 3.0 * against + 2.0)  # a bad vote speaks louder than a good one at the start
    chance, share = np.full((len(LABELLERS), 2, 3), 1 / 3), 0.5
    for _ in range(rounds if patterns else 0):
        share = float((weight * good).sum() / weight.sum())
        share = min(max(share, 0.01), 0.99)
        for k, part in enumerate((1 - good, good)):
            for vote in range(3):
                chance[:, k, vote] = ((votes == vote) * (weight * part)[:, None]).sum(0)
            prior = np.array([[2.0, 0.2], [0.2, 2.0]])[k]  # keeps the classes from changing places
            given = chance[:, k, :2] + prior
            chance[:, k, :2] = given / given.sum(1, keepdims=True)
            chance[:, k, NONE] = 1.0  # no vote says nothing: short texts get few
        logs = [np.log(p) + sum(np.log(chance[j, k, votes[:, j]]) for j in range(len(LABELLERS))) for k, p in ((0, 1 - share), (1, share))]
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return dict(zip(patterns, good.tolist())), chance, share


def _places(names, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of features of one kind, by a multiplicative hash of their CRCs."""
    codes = np.fromiter(map(crc32, names), np.uint64, len(names)) + np.uint64(kind << 32)
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(40)).astype(np.int64) % DIMENSIONS, np.where(mixed >> np.uint64(39) & np.uint64(1), 1.0, -1.0)


def features_of(stats: Stats) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: places and values; a place may come more than once, its values add up."""
    n = max(1, stats.n)
    single = [(b"bias", 1.0)]
    single += [(b"w:" + word, (c / n) ** 0.5) for word, c in stats.stops.items()]
    for name, value in stats.share.items():
        single.append((b"v:" + name.encode(), min(value, 10.0) ** 0.5))
        single.append((b"b:%s:%d" % (name.encode(), min(20, int(value * 20 if name != "length" else value * 2))), 1.0))
    of_shapes = np.fromiter(stats.shapes.values(), float, len(stats.shapes)) / n
    of_words = np.fromiter(stats.known.values(), float, len(stats.known)) / n
    parts = (
        ([name for name, _ in single], np.array([value for _, value in single])),
        (stats.shapes, of_shapes**0.5),
        (stats.known, CONTENT * of_words**0.5),
        ([word[-END:] for word in stats.known], of_words),
    )
    found = [(*_places(names, kind), value) for kind, (names, value) in enumerate(parts)]
    places = np.concatenate([at for at, _, _ in found])
    values = np.concatenate([sign * value for _, sign, value in found])
    if len(places) > DIMENSIONS:
        values = np.bincount(places, values, DIMENSIONS)
        places = np.arange(DIMENSIONS)
    return places.astype(np.int32), values.astype(np.float32)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], steps: int = 400, rate: float = 0.5, penalty: float = 1e-4, blocks: int = 8) -> np.ndarray:
    """Weights of a logistic scorer, by gradient steps scaled per weight, each over one of ``blocks`` blocks of rows in turn.

    The same rows in the same order give the same weights.
    """
    weights = np.zeros(DIMENSIONS)
    if not rows:
        return weights
    parts = []
    for block in np.array_split(np.arange(len(rows)), min(blocks, len(rows))):
        lengths = [len(rows[i][0]) for i in block]  # every row has features
        at = np.concatenate([rows[i][0] for i in block])
        x = np.concatenate([rows[i][1] for i in block]).astype(float)
        parts.append((at, x, np.repeat(np.arange(len(block)), lengths), np.cumsum([0, *lengths[:-1]]), np.array([rows[i][2] for i in block])))
    squares = np.full(DIMENSIONS, 1e-6)
    for step in range(steps):
        at, x, of, starts, y = parts[step % len(parts)]
        z = np.add.reduceat(x * weights[at], starts)
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.bincount(at, x * error[of], DIMENSIONS) / len(y) + penalty * weights
        squares += slope**2
        weights -= rate * slope / np.sqrt(squares)
    return weights


@dataclass
class Model:
    weights: np.ndarray
    posterior: dict[int, float]
    share: float
    threshold: float = THRESHOLD

    def judge(self, text: str | None) -> tuple[float, float]:
        """(score, posterior of its votes)."""
        stats = stats_of(text)
        if not stats.n:
            return 0.0, 0.0
        places, values = features_of(stats)
        z = float((values * self.weights[places]).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), self.posterior.get(pattern_of(stats), self.share)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD, text_col: str = "text") -> Model:
    """One pass over all documents for the votes, which also brings the sample's features."""
    total = docs.count()
    within = int(min(1.0, 1.2 * (fit_rows + 50) / max(1, total)) * (2**64 - 1)) - 2**63  # a bit more than fit_rows are expected
    schema = "pattern int, key long, places binary, values binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                stats = stats_of(text.as_py())
                pattern = pattern_of(stats)
                counts[pattern, 0] += 1
                if key <= within and stats.n:
                    places, values = features_of(stats)
                    rows.append((pattern, key, places.tobytes(), values.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["pattern", "key", "places", "values"])
        patterns = [p for p, _ in counts]
        n = len(patterns)
        if n:  # a row per pattern: its count stands where a sampled row has its key
            yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.int32()), pa.array(list(counts.values()), pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=["pattern", "key", "places", "values"])

    keyed = docs.select(F.xxhash64(F.lit(3), F.col("doc_id"), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    scanned = saved(map_batches(keyed, scan, schema), "quality-votes")
    counts = {r["pattern"]: r["n"] for r in scanned.where("places IS NULL").groupBy("pattern").agg(F.sum("key").alias("n")).collect()}  # at most PATTERNS rows
    posterior, _, share = fit_labels(counts)
    sample = scanned.where("places IS NOT NULL").orderBy("key", "pattern").limit(fit_rows).collect()
    rows = [(np.frombuffer(r["places"], np.int32), np.frombuffer(r["values"], np.float32), posterior[r["pattern"]]) for r in sample]
    return Model(fit_scorer(rows), posterior, share, threshold)


SCHEMA = "doc_id long, score double, posterior double, kept boolean"


def classify(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """doc_id, score, the posterior of its votes and kept, for each row."""
    model = model or fit(docs, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [model.judge(t.as_py()) for t in batch.column(1)]
            scores = np.array([s for s, _ in judged])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64()), pa.array([p for _, p in judged], pa.float64()), pa.array(scores >= model.threshold)], names=["doc_id", "score", "posterior", "kept"])

    return map_batches(docs.select("doc_id", F.col(text_col).cast("string").alias("text")), run, SCHEMA)


def keep_good(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """The rows that are kept, with all their columns."""
    model = model or fit(docs, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.judge(t.as_py())[0] >= model.threshold for t in batch.column(at)], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def op1_quality_model(docs: DataFrame) -> DataFrame:
    return classify(docs)
