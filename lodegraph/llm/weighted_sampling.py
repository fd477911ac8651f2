"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

The terms of a text are its 5-word shingles (of fewer words, all of them as one), lower-cased, each with the weight S, how
often it occurs. For each of ``SAMPLES`` samples a term has gamma variables r and c and a uniform b that depend on term and
sample alone; its step is t = floor(ln S / r + b), its rank a = c exp(-r (t - b + 1)), and the term of the least rank with
its step is the sample. Two texts have the same sample with the probability of their generalised Jaccard similarity, sum of
min(S) over sum of max(S). Every sample is taken over all distinct terms of the text.

The variables are drawn in another order, with the same joint law: with a1 of Exp(1), and E and w of Exp(1), let
z = ln(1 + E / a1); then r = z + w and c = a1 exp(z) are independent Gamma(2, 1), b = w / r is uniform, a = a1 for S = 1 and
a = a1 exp(-r floor((ln S + w) / r)) in general. So a term that occurs once, as most do, needs a1 alone, and as only the
order of ranks counts, that is one hash. Terms are rows; a text's samples are minima of columns, combined before they are
shuffled, so that no text needs more than its terms at once.

Equal texts have equal fingerprints; the share of equal samples estimates the similarity.

``fingerprint_edits`` also builds each text's edited form, from the next document in descending doc_id. That order is
found on ids alone by a range sort; the texts are shuffled once, by id.

Defined results: a null text is empty; an empty text's fingerprint is all zeros, alike only to those of empty texts; rows
are ordered by doc_id, null last, then by a hash of the text; rows that repeat a doc_id and its text stand as one in that
order and each get its result; a single document is its own next one; extra columns are ignored; an empty table gives an
empty result; a text's work grows with n log n in its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, saved, words_of

SAMPLES = 48
SHINGLE = 5
_RANKS = float(1 << 63)


def shingle_hashes(text: Column) -> Column:
    """Hashes of all shingles of a text, repeats included."""

    def windows(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < SHINGLE, F.array(F.xxhash64(w))).otherwise(many)

    return let(F.transform(words_of(F.lower(text)), lambda x: F.xxhash64(x)), windows)


def weighted_terms(text: Column) -> Column:
    """(h, s): each distinct shingle's hash and how often it occurs."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        one = lambda first, i, j: F.struct(F.get(s, i).alias("h"), (F.coalesce(F.get(first, j + 1), F.size(s)) - i).alias("s"))
        return let(starts, lambda first: F.transform(first, lambda i, j: one(first, i, j)))

    once = lambda s: F.transform(s, lambda x: F.struct(x.alias("h"), F.lit(1).alias("s")))
    return let(shingle_hashes(text), lambda s: F.when(F.size(F.array_distinct(s)) == F.size(s), once(s)).otherwise(let(F.sort_array(s), runs)))


def _first(term: Column, sample: Column) -> Column:
    """The rank of a term that occurs once: a1 as 1 - exp(-a1), a uniform number, times 2^63."""
    return F.shiftrightunsigned(F.xxhash64(term, sample), 1)


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows of terms (_h, _s) with _rank, the rank a in sample _k as 1 - exp(-a) times 2^63; null where _k is.

    Column by column, so that what is used twice is planned and computed once.
    """
    asked, uniform = F.col("_k").isNotNull(), lambda x: (x + F.lit(0.5)) / F.lit(float(1 << 32))
    rows = rows.withColumns({"_first": F.when(asked, _first(F.col("_h"), F.col("_k"))), "_bits": F.when(asked, F.xxhash64("_h", -1 - F.col("_k")))})
    e, w = -F.ln(uniform(F.shiftrightunsigned("_bits", 32))), -F.ln(uniform(F.col("_bits").bitwiseAND(F.lit((1 << 32) - 1))))
    rows = rows.withColumns({"_a1": -F.log1p(-(F.col("_first") + F.lit(0.5)) / F.lit(_RANKS)), "_w": w, "_x": e})
    rows = rows.withColumn("_r", F.log1p(F.col("_x") / F.col("_a1")) + F.col("_w"))
    rows = rows.withColumn("_step", F.floor((F.ln(F.col("_s").cast("double")) + F.col("_w")) / F.col("_r")))
    often = (-F.expm1(-F.col("_a1") * F.exp(-F.col("_r") * F.col("_step"))) * F.lit(_RANKS)).cast("long")
    return rows.withColumn("_rank", F.when(F.col("_step") == 0, F.col("_first")).otherwise(often))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys``, samples (an array of SAMPLES ints) and n_rows of each distinct key; rows of equal keys have equal texts.

    Terms are combined where they are made; where ``texts`` is dealt out by some of the keys, nothing is shuffled. A term
    that occurs more than once is a row for each sample (_k): its rank is a long expression, which as a column for each
    sample was most of a plan that the driver keeps and goes through again and again.
    """
    rows = texts.select(*keys, F.posexplode_outer(weighted_terms(F.col(text_col))).alias("_at", "_e")).select(*keys, "_at", F.col("_e.h").alias("_h"), F.col("_e.s").alias("_s"))
    rows = _ranked(rows.select("*", F.explode_outer(F.when(F.col("_s") > 1, F.array(*map(F.lit, range(SAMPLES))))).alias("_k")))
    once = F.col("_k").isNull() & F.col("_h").isNotNull()
    rank = lambda k: F.when(once, _first(F.col("_h"), F.lit(k))).when(F.col("_k") == k, F.col("_rank"))
    least = [F.min(rank(k)).alias(f"_{k}") for k in range(SAMPLES)]
    met = rows.groupBy(*keys).agg(*least, F.count_if((F.coalesce("_at", F.lit(0)) == 0) & (F.coalesce("_k", F.lit(0)) == 0)).alias("n_rows"))
    sample = lambda c: F.when(c.isNull(), 0).otherwise(F.hash(c))
    return met.select(*keys, F.array(*(sample(F.col(f"_{k}")) for k in range(SAMPLES))).alias("samples"), "n_rows")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(SAMPLES))


def as_text(samples: Column) -> Column:
    """Eight hex digits a sample."""
    return F.array_join(F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit((1 << 32) - 1))), 8, "0"))), "")


def next_keys(keys: DataFrame) -> DataFrame:
    """For distinct rows (d, th, z, n) in descending order the next row's key as nd and nth; the last one's is the first.

    Only ids are sorted. What a partition cannot see, the first row of the next one, comes from one row per partition.
    """
    order = [F.col("z").asc(), F.col("d").desc(), F.col("th").desc()]
    placed = saved(keys.sort(*order).withColumn("at", F.monotonically_increasing_id()), "fingerprint-order")
    part = F.shiftrightunsigned("at", 33)
    ends = placed.groupBy(part.alias("part")).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    along = Window.orderBy("part")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("last_at", F.coalesce(F.lead("first_at").over(along), F.min("first_at").over(whole)).alias("turn"))
    pointed = placed.join(F.broadcast(ends), F.col("at") == F.col("last_at"), "left")
    pointed = pointed.select("d", "th", "z", "n", F.coalesce("turn", F.col("at") + 1).alias("next_at"))
    follow = placed.select(F.col("at").alias("next_at"), F.col("d").alias("nd"), F.col("th").alias("nth"))
    return pointed.join(follow, "next_at").drop("next_at")


def fingerprint_edits(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints as arrays, near_edited and near_next."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(doc_id.isNull().alias("z"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("d"), F.xxhash64(text, doc_id.isNull()).alias("th"), text.alias("t"))
    links = next_keys(keyed.select("d", "th", "z", F.length("t").cast("long").alias("n")).distinct())
    # Both uses of the texts read the very same columns, so that one shuffle serves both.
    full = keyed.select("d", "th", "t").join(fingerprints(keyed.select("d", "th", "t"), ["d", "th"], "t").select("d", "th", F.col("samples").alias("fp")), ["d", "th"])
    # What each document wants of its next one: keyed by the next one's key.
    wanted = links.select(F.col("nd").alias("d"), F.col("nth").alias("th"), F.col("d").alias("rd"), F.col("th").alias("rth"), "z", F.floor(F.col("n") / 3).cast("int").alias("m"))
    heads = full.join(wanted, ["d", "th"]).select(F.col("rd").alias("d"), F.col("rth").alias("th"), "z", F.substr("t", F.lit(1), F.col("m")).alias("head"), F.col("fp").alias("next_fp"))
    heads = heads.groupBy("d", "th").agg(F.first("z").alias("z"), F.first("head").alias("head"), F.first("next_fp").alias("next_fp"))
    n = F.length("t")
    edited = F.concat(F.substr("t", F.lit(1), (n - F.floor(n / 3)).cast("int")), F.col("head"))
    own_id = F.when(~F.col("z"), F.col("d"))
    facts = ["d", "th", "doc_id", "n_chars", "edited_sha256", "fp", "next_fp"]
    joined = full.join(heads, ["d", "th"]).select("*", own_id.alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    made = fingerprints(joined, facts, "edited").withColumnRenamed("samples", "edited_fp")
    made = made.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")).alias("_copy"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", F.col("fp").alias("samples"), F.col("edited_fp").alias("edited_samples"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op5_weighted_sampling(docs: DataFrame) -> DataFrame:
    found = fingerprint_edits(docs)
    return found.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("samples")).alias("fingerprint"), as_text(F.col("edited_samples")).alias("edited_fingerprint"), "near_edited", "near_next")
