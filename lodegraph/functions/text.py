"""Scalar text, hash, date and array functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token and word patterns.
TOKEN = "[a-zà-ɏ]{2,}"
WORD = "[a-z0-9à-ɏ]+"


def tokens(text: Column) -> Column:
    """Lower-case letter runs of two or more; digits are no tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def normalise_text(text: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed to one blank."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def content_sha(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the first 8000 characters."""
    return F.substring(F.sha2(F.substring(text, 1, 8000), 256), 1, 16)


def text_hash(text: Column) -> Column:
    return F.sha2(normalise_text(text), 256)


def canonical_hash(text: Column) -> Column:
    """SHA-256 without a byte order mark and with Unix line ends."""
    bare = F.regexp_replace(text, "^﻿", "")
    return F.sha2(F.regexp_replace(bare, "\r\n?", "\n"), 256)


def chunk_id(source: Column, start: Column, text: Column) -> Column:
    return F.concat(F.lit("ch_"), F.substring(F.md5(F.concat_ws(":", source, start.cast("string"), F.substring(text, 1, 100))), 1, 8))


def pair_id(scope: Column, a: Column, b: Column) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.substring(F.sha2(F.concat_ws("::", scope, F.least(a, b), F.greatest(a, b)), 256), 1, 8)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: both empty 1, one empty 0."""
    whole = F.size(F.array_union(a, b))
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / whole)


def ngrams(words: Column, n: int) -> Column:
    """Distinct n-grams, words joined by blanks."""
    at = F.sequence(F.lit(1), F.size(words) - (n - 1))
    grams = F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def query_terms(words: Column) -> Column:
    """Words, and their bigrams joined by a hyphen and by a blank."""
    at = F.sequence(F.lit(1), F.size(words) - 1)
    pair = lambda by: F.transform(at, lambda i: F.array_join(F.slice(words, i, 2), by))
    return F.when(F.size(words) < 2, words).otherwise(F.concat(words, pair("-"), pair(" ")))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, one at least; none for an empty text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def sentences(text: Column) -> Column:
    """Cut at white space after a full stop, exclamation or question mark."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def word_delta(text: Column, start_word: int) -> Column:
    """Words from index ``start_word`` on, joined by single blanks."""
    words = F.split(F.trim(text), r"\s+")
    return F.array_join(F.slice(words, start_word + 1, F.greatest(F.size(words), F.lit(1))), " ")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def sanitise_query(text: Column, most: int = 500) -> Column:
    """Cut to ``most`` characters, without code fences and tags, white space collapsed."""
    cut = F.substring(text, 1, most)
    bare = F.regexp_replace(F.regexp_replace(cut, "```", ""), "<[^>]*>", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def recency(days: Column, rate: float = 0.05) -> Column:
    """Exponential decay by age in days."""
    return F.exp(-F.lit(rate) * days)


def composite_score(importance: Column, recent: Column, references: Column) -> Column:
    return 0.2 * importance + 0.3 * recent + 0.5 * F.least(references / 10, F.lit(1.0))


def effort_band(minutes: Column) -> Column:
    """1 to 6 by duration; 3 where it is missing or not positive."""
    band = F.when(minutes.isNull() | (minutes <= 0), 3)
    for limit, value in ((1, 1), (2, 2), (10, 3), (30, 4), (60, 5)):
        band = band.when(minutes <= limit, value)
    return band.otherwise(6)


def grade(score: Column) -> Column:
    out = None
    for least, name in ((90, "A"), (80, "B"), (70, "C"), (60, "D")):
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("F")


def gauge(level: Column, of: int = 5) -> Column:
    """``level`` filled places of ``of``."""
    return F.concat(F.repeat(F.lit("#"), level), F.repeat(F.lit("."), of - level))


def epoch_text(value: Column) -> Column:
    """Epoch milliseconds (above 1e12) or seconds as minutes in UTC; Unknown where it is missing or not positive."""
    ms = F.when(value > 1e12, value).otherwise(value * 1000).cast("long")
    return F.when(value > 0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm")).otherwise("Unknown")


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def youtube_id(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?:v=|youtu\.be/|embed/|shorts/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def json_metadata(raw: Column) -> Column:
    """A JSON object as a map; an empty map where it is none."""
    return F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))


def parse_vector(raw: Column) -> Column:
    return F.from_json(raw, "array<double>")


def amount(text: Column) -> Column:
    """Number with thousands commas and a k, m or b: its value."""
    bare = F.regexp_replace(F.lower(text), "[$,\\s]", "")
    number = F.try_to_number(F.regexp_extract(bare, r"^([0-9]+(?:\.[0-9]+)?)", 1), F.lit("999999999999.999999")).cast("double")
    unit = F.regexp_extract(bare, "([kmb])$", 1)
    return number * F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length one; all zeros where it has no length."""
    scaled = F.transform(F.array(F.sqrt(dot(a, a))), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))
    return F.get(scaled, F.lit(0))
