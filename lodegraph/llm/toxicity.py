"""Toxicity by a weighted finite-state grammar of clauses.

A text is cut into clauses and each clause's words into classes: insult, threat, target, intent, negation, report and other.
Four transducers rewrite the classes one after the other and are composed into one machine:

* ``INTENT``: a threat is one where an intent stands shortly before it, else it is a mere verb;
* ``NEGATION``: what stands in the scope of a negation is denied;
* ``REPORT``: what follows a verb of saying is told, not said;
* ``TARGET``: what stands shortly after a target is aimed.

What comes out is a matched clause's kinds, each with a weight (``KIND_WEIGHTS``), times the weight of the word that was
matched. The words of insults and threats come from two places: seeds with a fixed weight, and a lexicon that is learned
from labelled rows. The lexicon is an automaton over whole words, beginnings and ends of words; an arc's weight is a lower
bound of the log-odds of toxic against other texts. Its unit of evidence is a distinct pair of a word and the word before
it, so that a passage that is copied a thousand times counts once. A word has the largest weight that the automaton reads
in it.

Per text, sums, maxima and densities of its clauses' weights go into a logistic scorer. It is fitted to features that were
made with a lexicon of the other half of the rows (by hash of the text), so that it learns what the lexicon is worth on
rows it has not seen.

Learning takes at most about ``fit_rows`` labelled rows, the ones with the smallest hashes; counts are aggregated by Spark,
the ``LEXICON`` best arcs and the rows' features come to the driver. Scoring reads each whole text once.

Defined results: a null or empty text scores what a text without a match and without words does; a label of several rows
is toxic if any says so, null labels say nothing; without toxic or without other rows fixed coefficients stand; repeated
rows are scored one by one; a null doc_id stays null and is never held out; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from math import exp, log, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, saved

#: Bound on the labelled rows that are learned from.
FIT_ROWS = 20_000
#: Bound on the learned arcs, and what an arc needs: pairs in toxic rows and log-odds.
LEXICON, LEAST_PAIRS, LEAST_ODDS = 20_000, 4, 1.5
MOST_ODDS, SEED_ODDS = 8.0, 4.0
PREFIXES, SUFFIXES = range(3, 9), range(4, 7)
#: Words that a beginning or an end must have in common.
LEAST_WORDS = 3
THRESHOLD = 0.7

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[^.!?;:,\n]+")

#: Words of the grammar's classes, in English, German, French and Spanish.
INSULTS = ("idiot", "moron", "loser", "scum", "trash", "stupid", "worthless", "pathetic", "disgusting", "bastard", "imbecile",
           "dummkopf", "trottel", "arschloch", "abschaum", "connard", "salaud", "imbécile", "estúpido", "imbécil", "basura")
THREATS = ("kill", "hurt", "destroy", "beat", "stab", "shoot", "burn", "umbringen", "töten", "verletzen", "tuer", "détruire", "frapper", "matar", "destruir", "golpear")
TARGETS = ("you", "your", "you're", "he", "she", "they", "them", "him", "her", "these", "those", "people", "du", "dich", "sie", "ihr", "tu", "toi", "vous", "ils", "elles", "tú", "usted", "ellos", "ellas")
INTENTS = ("will", "gonna", "going", "shall", "must", "want", "should", "werde", "werden", "will", "muss", "vais", "allons", "voy", "vamos", "quiero")
NEGATIONS = ("not", "no", "never", "nobody", "hardly", "isn", "aren", "wasn", "don", "nicht", "kein", "keine", "nie", "ne", "pas", "jamais", "nunca", "jamás")
REPORTS = ("said", "says", "called", "wrote", "quoted", "claimed", "reported", "alleged", "sagte", "schrieb", "nannte", "disait", "écrit", "appelé", "dijo", "escribió", "llamó")
INSULT, THREAT, TARGET, INTENT, NEGATION, REPORT, OTHER = "insult", "threat", "target", "intent", "negation", "report", "other"
CLASSES = {w: c for c, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (INTENT, INTENTS), (TARGET, TARGETS)) for w in words}
SEEDS = {w: (c, SEED_ODDS) for c, words in ((INSULT, INSULTS), (THREAT, THREATS)) for w in words}


def scoped(opener: str, length: int, rewritten: dict[str, str], outside: dict[str, str] | None = None):
    """A transducer: ``opener`` opens a scope of ``length`` symbols in which symbols are rewritten by their first part."""

    def step(state: int, symbol: str) -> tuple[int, str]:
        head, _, marks = symbol.partition("+")
        table = rewritten if state else outside or {}
        out = table.get(head, head) + ("+" + marks if marks else "")
        return (length if head == opener else max(0, state - 1)), out

    return step


def marked(opener: str, length: int, mark: str):
    """A transducer that marks insults and threats in the scope of ``opener``."""
    plain = scoped(opener, length, {})

    def step(state: int, symbol: str) -> tuple[int, str]:
        after, out = plain(state, symbol)
        return after, f"{out}+{mark}" if state and out.partition("+")[0] in (INSULT, THREAT) else out

    return step


CASCADE = (
    scoped(INTENT, 3, {}, {THREAT: OTHER}),
    marked(NEGATION, 4, "denied"),
    marked(REPORT, 40, "told"),
    marked(TARGET, 5, "aimed"),
)
#: What a match of a kind weighs.
MARK_WEIGHTS = {"denied": 0.3, "told": 0.5, "aimed": 1.5}
KIND_WEIGHTS = {INSULT: 1.0, THREAT: 1.2}


@cache
def composed(states: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], str]:
    """One step of the composed machine; its arcs are made when they are first taken (states and symbols are few)."""
    after = []
    for step, state in zip(CASCADE, states):
        state, symbol = step(state, symbol)
        after.append(state)
    return tuple(after), symbol


@cache
def kind_weight(symbol: str) -> float:
    head, *marks = symbol.split("+")
    weight = KIND_WEIGHTS.get(head, 0.0)
    for mark in marks:
        weight *= MARK_WEIGHTS[mark]
    return weight


@dataclass
class Lexicon:
    """Weights of whole words, of beginnings and of ends of words."""

    words: dict[str, float] = field(default_factory=dict)
    begins: dict[str, float] = field(default_factory=dict)
    ends: dict[str, float] = field(default_factory=dict)
    _known: dict[str, tuple[str, float]] = field(default_factory=dict)

    def of(self, word: str) -> tuple[str, float]:
        """(class, weight) of a word in lower case; a weight of 0 is no match."""
        found = self._known.get(word)
        if found is None:
            kind, weight = SEEDS.get(word, (INSULT, 0.0))
            learned = max((self.words.get(word, 0.0), *(self.begins.get(word[:k], 0.0) for k in PREFIXES if len(word) >= k), *(self.ends.get(word[-k:], 0.0) for k in SUFFIXES if len(word) >= k)))
            found = kind, max(weight, learned)
            if len(self._known) > 300_000:
                self._known.clear()
            self._known[word] = found
        return found

    def __getstate__(self):
        return {"words": self.words, "begins": self.begins, "ends": self.ends, "_known": {}}


@dataclass(frozen=True)
class Match:
    start: int
    end: int
    kind: str
    word: str
    weight: float


def matches(text: str | None, lexicon: Lexicon) -> tuple[list[Match], int]:
    """What the grammar finds in a text's clauses (code points, the end exclusive), and the number of its words."""
    lower = (text or "").lower()
    if len(lower) != len(text or ""):  # few capitals have two code points in lower case
        lower = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    words = WORD.findall(lower)
    hits = {w for w in set(words) if lexicon.of(w)[1]}
    if not hits:
        return [], len(words)
    out = []
    for clause in CLAUSE.finditer(lower):
        own = WORD.findall(clause[0])
        if hits.isdisjoint(own):
            continue
        states = (0,) * len(CASCADE)
        for word in own:
            kind, weight = lexicon.of(word) if word in hits else (CLASSES.get(word, OTHER), 0.0)
            states, symbol = composed(states, kind)
            if weight and (w := kind_weight(symbol)):
                out.append(Match(clause.start(), clause.end(), symbol, word, w * weight))
    return out, len(words)


N_FEATURES = 6


def features(found: list[Match], n_words: int) -> list[float]:
    total = sum(m.weight for m in found)
    return [1.0, log1p(total), log1p(50 * total / (n_words + 20)), log1p(len({m.word for m in found})), max((m.weight for m in found), default=0.0), log1p(n_words) / 4]


#: Coefficients that stand where there is nothing to learn from.
FIXED = np.array([-4.0, 1.5, 0.5, 0.5, 0.2, 0.0])


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: np.ndarray = field(default_factory=lambda: FIXED.copy())

    def score(self, text: str | None) -> float:
        return float(1 / (1 + exp(-min(30.0, max(-30.0, float(self.coefficients @ np.array(features(*matches(text, self.lexicon)))))))))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: the checksum of the id's text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _within(rows: int, wanted: int, *key: str) -> Column:
    """About ``wanted`` of ``rows`` rows, by the hash of ``key``."""
    share = min(1.0, wanted / max(1, rows))
    return F.lit(True) if share == 1.0 else F.xxhash64(F.lit(11), *key) <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, text_col: str = "text") -> DataFrame:
    """text, toxic and half of at most about ``fit_rows`` labelled rows that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    few = known.where(_within(known.count(), fit_rows, "doc_id"))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = saved(picked.join(F.broadcast(few), "doc_id").select("doc_id", "text", "toxic"), "toxicity-rows")  # about fit_rows ids
    n = rows.count()
    if n > 1.5 * fit_rows:  # ids with very many rows
        rows = rows.where(_within(n, fit_rows, "doc_id", "text"))
    return rows.select("text", "toxic", (F.xxhash64(F.lit(12), "text") % 2 != 0).cast("int").alias("half"))


def _pairs(rows: DataFrame) -> DataFrame:
    """word, the word before it, toxic and half: the distinct ones of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = WORD.findall((text.as_py() or "").lower())
                found = list(set(zip(words, ["", *words])))
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([b for _, b in found], pa.string()), pa.array([toxic] * n, pa.int32()), pa.array([half] * n, pa.int32())], names=["word", "before", "toxic", "half"])

    return map_batches(rows, run, "word string, before string, toxic int, half int")


COUNTS = ("t0", "t1", "c0", "c1")


def odds(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    """A lower bound of the log-odds of a term, at most MOST_ODDS; 0 where it is too rare or too small."""
    if toxic < LEAST_PAIRS:
        return 0.0
    value = log((toxic - sqrt(toxic) + 0.5) / (all_toxic + 1)) - log((clean + sqrt(clean) + 1) / (all_clean + 1))
    return min(MOST_ODDS, value) if value >= LEAST_ODDS else 0.0


def term_counts(rows: DataFrame) -> DataFrame:
    """kind (w, b or e), term, its distinct pairs in toxic (t) and other (c) rows of either half, and the words of its toxic pairs."""
    distinct = _pairs(rows).groupBy("word", "before").agg(*(F.max(((F.col("toxic") == int(name[0] == "t")) & (F.col("half") == int(name[1]))).cast("int")).alias(name) for name in COUNTS))
    per_word = distinct.groupBy("word").agg(*(F.sum(name).alias(name) for name in COUNTS))
    term = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("term"))
    long = lambda k: F.length("word") >= k
    terms = [term("w", F.col("word"))]
    terms += [F.when(long(k), term("b", F.substring("word", 1, k))) for k in PREFIXES] + [F.when(long(k), term("e", F.col("word").substr(F.length("word") - (k - 1), F.lit(k)))) for k in SUFFIXES]
    each = per_word.select(F.explode(F.array(*terms)).alias("t"), *COUNTS).where("t IS NOT NULL")
    toxic_words = F.sum((F.col("t0") + F.col("t1") > 0).cast("int")).alias("words")
    return each.groupBy("t.kind", "t.term").agg(*(F.sum(name).alias(name) for name in COUNTS), toxic_words)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, text_col: str = "text") -> Model:
    rows = training_rows(docs, labels, fit_rows, text_col)
    terms = saved(term_counts(rows), "toxicity-terms")
    totals = terms.where("kind = 'w'").agg(*(F.sum(name).alias(name) for name in COUNTS)).collect()[0]
    t0, t1, c0, c1 = (float(x or 0) for x in totals)
    ratio = (F.col("t0") + F.col("t1") + 0.5) / (F.col("c0") + F.col("c1") + 1)
    least = exp(LEAST_ODDS) * (t0 + t1 + 1) / (c0 + c1 + 1)
    # An arc of a half alone may pass where that of both does not, so the halves' bounds are left to the driver.
    shared = (F.col("kind") == "w") | (F.col("words") >= LEAST_WORDS)  # else it is one word's, and would match others by chance
    best = terms.where(shared & (F.col("t0") + F.col("t1") >= LEAST_PAIRS) & (ratio >= least / 2)).orderBy(F.desc(ratio * F.sqrt(F.col("t0") + F.col("t1"))), "kind", "term").limit(LEXICON).collect()

    def lexicon(take) -> Lexicon:
        out = Lexicon()
        for r in best:
            if value := odds(*take(r["t0"], r["t1"]), *take(r["c0"], r["c1"]), *take(t0, t1), *take(c0, c1)):
                {"w": out.words, "b": out.begins, "e": out.ends}[r["kind"]][r["term"]] = value
        return out

    halves = [lexicon(lambda a, b: (a,)), lexicon(lambda a, b: (b,))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(*matches(t.as_py(), halves[1 - h])) for t, h in zip(batch.column(0), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    seen = map_batches(rows, run, "x array<double>, toxic int").collect()  # about fit_rows rows of N_FEATURES numbers
    x, y = np.array([r["x"] for r in seen]).reshape(-1, N_FEATURES), np.array([r["toxic"] for r in seen], float)
    order = np.lexsort((*x.T, y))
    return Model(lexicon(lambda a, b: (a + b,)), fitted(x[order], y[order]))


def fitted(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Coefficients of a logistic scorer by Newton's method, drawn to the fixed ones by ``penalty``."""
    if not 0 < y.sum() < len(y):
        return FIXED.copy()
    w = FIXED.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * (w - FIXED)
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """doc_id and score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, score double")


MATCHED = "doc_id long, start long, end long, kind string, word string, weight double"


def matched_clauses(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The matched words of each row with the clause in which they stand, what the grammar calls them and their weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for m in matches(t.as_py(), model.lexicon)[0]]
            columns = [[i for i, _ in rows], *([getattr(m, name) for _, m in rows] for name in ("start", "end", "kind", "word", "weight"))]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "start", "end", "kind", "word", "weight"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, MATCHED)


def op11_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = scored(docs, fit(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
