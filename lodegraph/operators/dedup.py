"""Deduplication, set operations and the ingestion verdict."""

from __future__ import annotations

from itertools import combinations, pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import text as T

MIN_BODY_WORDS = 50
MAX_HAMMING = 3


def keep_first(frame: DataFrame, key: Column, position: str, always: Column | None = None) -> DataFrame:
    """The first row of each key by ``position``; rows where ``always`` holds are kept besides.

    Only the keys' least positions are shuffled with the rows, not a whole group to one place.
    """
    keyed = frame.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min(position).alias("_first"))
    keep = F.col(position) == F.col("_first")
    if always is not None:
        keep = keep | always
    return keyed.join(first, keyed["_key"].eqNullSafe(first["_key"])).where(keep).drop("_key", "_first")


def content_sha_dedup(docs: DataFrame, position: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops later copies of a text; empty texts all stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return keep_first(docs.withColumn("content_sha", T.content_sha(text)), F.col("content_sha"), position, text == "")


def hash_groups(docs: DataFrame, hashed: Column, id_col: str = "doc_id") -> DataFrame:
    """Hashes that more than one document has: first id and size."""
    groups = docs.groupBy(hashed.alias("hash")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies"))
    return groups.where("copies > 1")


def body_words(text: Column) -> Column:
    return F.filter(F.split(T.normalise_text(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


#: Header lines and separators that are no body, and what changes between copies of one meeting.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
HEADER_LINE = r"(?i)^\s*(title|date|duration|participants|source|transcript\s*id|meeting\s*transcript)\b"
SEPARATOR_LINE = r"^=+\s*$"
MEETING_ID = r"(?i)\[?\bMEET[-_]?\d+\]?"
DATE_OR_TIME = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}:\d{2}(?::\d{2})?|gmt[-+]?\d{0,2}(?::\d{2})?"
NO_LETTER = r"[^a-zà-ÿ\s]"


def near_words(text: Column) -> Column:
    """The words of a body for near duplicates: letters alone, without header lines, separators, meeting ids, dates and times."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(SEPARATOR_LINE) & ~x.rlike(HEADER_LINE))
    bare = F.regexp_replace(F.array_join(kept, " "), MEETING_ID, " ")
    bare = F.regexp_replace(F.regexp_replace(F.lower(bare), DATE_OR_TIME, " "), NO_LETTER, " ")
    return F.filter(F.split(bare, r"\s+"), lambda w: w != "")


#: Shingles whose votes fit into lanes of eight bits, the highest of which holds the sign.
LANE = 127
#: A bit in each lane of eight bits.
LANES = 0x0101010101010101


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = MIN_BODY_WORDS) -> DataFrame:
    """(id, simhash): 64 bits, each the majority of the bits of md5 over 3-word shingles, repeats included.

    Votes are counted within the row, so nothing is shuffled: the k-th of eight counters adds up every eighth bit of the
    hashes from the k-th on, each in a lane of eight bits, and is put by after 127 hashes. Short bodies have none.
    """
    words = docs.select(F.col(id_col).alias("id"), near_words(F.col(text_col)).alias("w")).where(F.size("w") >= F.greatest(F.lit(1), F.lit(least_words)))
    hashes = "transform(sequence(1, greatest(1, size(w) - 2)), i -> cast(conv(substring(md5(array_join(slice(w, i, 3), ' ')), 1, 16), 16, -10) AS BIGINT))"
    votes = f"transform(sequence(0, (size(h) - 1) div {LANE}), s -> aggregate(slice(h, cast(s * {LANE} + 1 AS INT), {LANE}), array_repeat(0L, 8), (c, x) -> transform(c, (v, k) -> v + (shiftrightunsigned(x, k) & {LANES}L))))"
    ones = "aggregate(votes, 0L, (n, c) -> n + (shiftrightunsigned(element_at(c, b % 8 + 1), cast(8 * (b div 8) AS INT)) & 255L))"
    bits = f"aggregate(sequence(0, 63), 0L, (r, b) -> r | if(2 * {ones} > size(h), shiftleft(1L, b), 0L))"
    # A lambda over an array of one computes its value once, however often its body uses it and wherever a filter is pushed.
    return words.select("id", F.expr(f"transform(array(w), w -> transform(array({hashes}), h -> transform(array({votes}), votes -> {bits})[0])[0])[0]").alias("simhash"))


def hamming_pairs(prints: DataFrame, most: int = MAX_HAMMING) -> DataFrame:
    """(a, b, distance) of distinct fingerprints within ``most`` bits: of most + 3 blocks three must agree.

    Each choice of three blocks is a key of about half the bits, so few prints share one by chance. Equal fingerprints are
    one row, so copies are never paired; 0 never matches.
    """
    distinct = prints.groupBy("simhash").agg(F.min("id").alias("id"), F.max("simhash").alias("own")).where("own <> 0")  # a filter of the key would compute prints twice
    edges = [64 * k // (most + 3) for k in range(most + 4)]
    masks = [((1 << b) - (1 << a)) for a, b in pairwise(edges)]
    keys = [sum(m) - (1 << 64 if sum(m) >> 63 else 0) for m in combinations(masks, 3)]
    banded = distinct.select("id", "simhash", F.posexplode(F.array(*(F.col("simhash").bitwiseAND(F.lit(k)) for k in keys))).alias("k", "v"))
    left, right = banded.alias("l"), banded.alias("r")
    met = left.join(right, (F.col("l.k") == F.col("r.k")) & (F.col("l.v") == F.col("r.v")) & (F.col("l.id") < F.col("r.id")))
    pairs = met.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), T.hamming(F.col("l.simhash"), F.col("r.simhash")).alias("distance"))
    return pairs.where(F.col("distance") <= most).distinct()


def ingest_verdict(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """For incoming (key, body) against registry (key, body_hash, words): skip, process or incremental, and why."""
    now = incoming.select("key", T.text_hash(F.col("body")).alias("body_hash"), F.size(body_words(F.col("body"))).alias("words"))
    own = registry.select("key", F.col("body_hash").alias("old_hash"), F.col("words").alias("old_words"))
    any_ = registry.groupBy("body_hash").agg(F.min("key").alias("holder"))
    joined = now.join(own, "key", "left").join(any_, "body_hash", "left")
    reason = (
        F.when(F.col("words") < MIN_BODY_WORDS, "tiny_body")
        .when(F.col("old_hash") == F.col("body_hash"), "unchanged")
        .when(F.col("holder").isNotNull(), "duplicate_body")
        .when(F.col("old_hash").isNull(), "new")
        .when(F.col("words") > F.col("old_words"), "grown")
        .otherwise("changed")
    )
    verdict = F.when(F.col("reason").isin("tiny_body", "unchanged", "duplicate_body"), "skip").when(F.col("reason") == "grown", "incremental").otherwise("process")
    return joined.withColumn("reason", reason).select("key", "words", "reason", verdict.alias("verdict"))


def difference(all_: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return all_.join(done.select(key).distinct(), key, "left_anti")


def conflicts(decided: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return decided.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values")).where(F.size("values") > 1)


def hour_key(title: Column, ts: Column) -> Column:
    """Meeting key: normalised title and the hour."""
    return F.concat_ws("|", T.normalise_text(title), F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd HH"))


def first_within(frame: DataFrame, key: str, ts: str, days: int) -> DataFrame:
    """Flags rows whose key was seen at most ``days`` before as duplicates."""
    last = F.lag(ts).over(Window.partitionBy(key).orderBy(ts))
    return frame.withColumn("duplicate", F.coalesce(F.col(ts) <= last + F.make_dt_interval(F.lit(days)), F.lit(False)))
