"""Quality rules: a threshold table compiled into one projection, without user functions.

``quality_rules(docs)`` returns one row per input row. Defined results:

* a null or empty text has no words: every count is 0, and it fails the base rule (fewer than 10 words);
* repeated rows are judged one by one, extra columns are ignored, an empty table gives an empty result;
* a null doc_id is kept as it is;
* very long texts cost n log n in their number of words.

Windows of five words are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, words_of

#: The symbols that count as such.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "it", "that", "for", "was", "on", "are", "as", "with", "be", "this", "by", "from", "at",
    "le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "est", "que", "qui", "dans", "pour", "par", "sur", "au", "aux", "avec",
    "der", "die", "das", "und", "ist", "ein", "eine", "den", "dem", "des", "zu", "mit", "von", "nicht", "sich", "auf", "für", "als", "im", "an",
    "el", "los", "las", "del", "y", "no", "una", "su", "con", "para", "al", "se", "lo", "como", "por", "más", "o", "pero", "sus", "e",
)
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Fails where ``100 * part > most * whole`` or ``100 * part < least * whole``; ``whole`` of 0 never fails.

    ``applies_from``: the rule is silent for texts with fewer words.
    """

    name: str
    part: str
    whole: str
    most: int | None = None
    least: int | None = None
    applies_from: int = 0


#: The production table: length, symbol, stop-word and line ratios in percent.
RULES = (
    Rule("word_length", "word_chars", "n_words", most=2000, least=150),
    Rule("symbols", "n_symbols", "n_words", most=30),
    Rule("bangs", "n_bangs", "n_words", most=50),
    Rule("stop_words", "n_stop_words", "n_words", least=2, applies_from=50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=50),
)
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def _covered(hashes: Column) -> Column:
    """Positions within windows whose hash occurs twice or more."""

    def positions(ordered: Column) -> Column:
        def flag(e: Column, i: Column) -> Column:
            same = (e["h"] == F.get(ordered, i - 1)["h"]) | (e["h"] == F.get(ordered, i + 1)["h"])
            return F.when(same, e["p"])

        return F.sort_array(F.filter(F.transform(ordered, flag), lambda p: p.isNotNull()))

    def total(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return let(let(ordered, positions), total)


def repeat_words(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more in the text, the first occurrence included."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    count = let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(count)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents' other columns aside, doc_id and every count that a rule can name."""
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    staged = docs.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("_text"), words_of(F.col(text_col)).alias("_words"))
    return staged.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        _without(F.col("_text"), SPACES).cast("long").alias("word_chars"),
        (F.length("_text") - _without(F.col("_text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("_text") - _without(F.col("_text"), "!")).cast("long").alias("n_bangs"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
    ).select("*", F.col("_lines.all").alias("n_lines"), F.col("_lines.dup").alias("n_dup_lines")).drop("_lines")


def verdict(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row of ``measures`` fails."""
    failed = []
    for r in rules:
        part, whole = 100 * F.col(r.part), F.col(r.whole)
        bad = F.lit(False)
        if r.most is not None:
            bad = bad | (part > r.most * whole)
        if r.least is not None:
            bad = bad | (part < r.least * whole)
        failed.append(F.when(bad & (whole > 0) & (F.col("n_words") >= r.applies_from), F.lit(r.name)))
    return F.array_compact(F.array(*failed))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, failed_rules and kept for each row."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = measures(docs, text_col).withColumns({"base_failed": base, "failed_rules": verdict(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op9_quality_rules(docs: DataFrame) -> DataFrame:
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rule_sql(r: Rule) -> str:
    bad = [f"100 * {r.part} > {r.most} * {r.whole}"] * (r.most is not None) + [f"100 * {r.part} < {r.least} * {r.whole}"] * (r.least is not None)
    return f"(({' OR '.join(bad)}) AND {r.whole} > 0 AND n_words >= {r.applies_from})"


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS u(i)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM dup, range(0, 5) AS r(k) GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL})))::BIGINT AS n_stop_words,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)
), j AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(map(_rule_sql, RULES))}) AS kept FROM j
"""
