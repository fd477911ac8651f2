"""Audit of how filters interact, from Walsh-Hadamard coefficients.

Every document fails some of the five filters; its failures are a mask of five bits. Per part and label (all documents, good
ones, toxic ones) 32 signed parity sums are aggregated: the k-th adds each document once, negative where it fails an odd
number of the filters in k. The inverse transform turns the sums into exact counts of the 32 masks, and all that is asked
of the 120 orders follows from these cells: after a prefix P of an order, a document is kept if its mask avoids P. Summed
over all orders, each of the n filters that a document fails removes it 120 / n times (the Shapley value in closed form).

Filters A to D look at one text, in Arrow batches; E needs all texts: it is found by groups of equal digests, counted per
mask, part and label before they are shuffled, so that a group of copies of any size is a few rows. No text is shuffled.

Defined results: a null text is an empty one; a null source is the part '', as an empty one is; a document with several
rows in ``labels`` has a label if any row says so, null labels say nothing, a null doc_id has none; repeated rows count one
by one; of rows with equal text and equal doc_id none is a copy of the other; a null doc_id is neither a copy nor an
original; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Bounds of the filters: least words, least percentage of distinct words, greatest percentage of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
#: The characters that filter D looks for, and capitals.
MARKS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = 1 << FILTERS.index("E")
LABELS = ("all", "good", "toxic")


def mask_of(text: str | None) -> tuple[int, bytes]:
    """The failures of A to D as bits, and a digest of the text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at ASCII white space
    mask = len(words) < LEAST_WORDS
    mask |= (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
    mask |= (100 * (len(data) - len(data.translate(None, CAPITALS))) > MOST_CAPITALS * len(text)) << 2
    mask |= (len(data.translate(None, MARKS)) < len(data)) << 3
    return mask, blake2b(data, digest_size=16).digest()


def _masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and mask of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [mask_of(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([d for _, d in found], pa.binary()), pa.array([m for m, _ in found], pa.int32())],
                names=["doc_id", "part", "digest", "mask"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return map_batches(picked, run, "doc_id long, part string, digest binary, mask int")


def _flags(labels: DataFrame) -> DataFrame:
    has = lambda column: F.coalesce(F.max((F.col(column) == 1).cast("int")), F.lit(0))
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(has("quality").alias("good"), has("toxic").alias("toxic"))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask of all five filters and n, the rows that have them; not yet added up over digests."""
    key = ["digest", "part", "good", "toxic", "mask"]
    rows = _masked(docs).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))  # repeated rows become one
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    known = rows.join(_flags(labels), "doc_id", "left").select("doc_id", "digest", "part", "mask", "n", zero("good"), zero("toxic"))
    groups = known.groupBy(*key).agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("first"),
        F.min_by("n", "doc_id").alias("n_first"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
    )
    # The same doc_id and text may stand in several groups, in parts of their own; a group's first is an original where it is the digest's.
    own = groups.withColumn("least", F.min("first").over(Window.partitionBy("digest")))  # a digest has at most four rows a part
    originals = F.col("n_null") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    sides = F.array(F.struct(F.col("mask").alias("mask"), originals.alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - originals).alias("n")))
    return own.select("part", "good", "toxic", F.inline(sides)).where("n > 0")


def _sign(bits: Column) -> Column:
    """-1 where an odd number of bits is set."""
    return F.lit(1) - 2 * (F.bit_count(bits) % 2)


def parity_sums(cells: DataFrame) -> DataFrame:
    """part, label and the 32 signed parity sums of its documents."""
    labels = F.filter(F.array(F.lit("all"), F.when(F.col("good") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    told = cells.select("part", "mask", "n", F.explode(labels).alias("label"))
    sums = [F.sum(F.col("n") * _sign(F.col("mask").bitwiseAND(F.lit(k)))).alias(f"s{k}") for k in range(CELLS)]
    return told.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*(f"s{k}" for k in range(CELLS))).alias("sums"))


def _range() -> Column:
    return F.sequence(F.lit(0), F.lit(CELLS - 1))


def cell_counts(sums: DataFrame) -> DataFrame:
    """The inverse transform: per part, an array of exact counts of the 32 masks for each label."""
    cell = lambda m: F.aggregate(_range(), F.lit(0).cast("long"), lambda so_far, k: so_far + F.get("sums", k) * _sign(k.bitwiseAND(m)))
    counts = sums.select("part", "label", F.transform(_range(), lambda m: F.shiftright(cell(m), len(FILTERS))).alias("cells"))  # multiples of 32
    none = F.array_repeat(F.lit(0).cast("long"), CELLS)
    return counts.groupBy("part").agg(*(F.coalesce(F.max(F.when(F.col("label") == label, F.col("cells"))), none).alias(label) for label in LABELS))


def _steps(counts: DataFrame) -> DataFrame:
    """What each filter does after each set of earlier ones: 80 rows a part; ``before`` and ``filter`` are bits."""
    sets = [(before, 1 << k) for k in range(len(FILTERS)) for before in range(CELLS) if not before >> k & 1]
    each = counts.select("*", F.inline(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(f).alias("filter")) for b, f in sets))))
    fails = lambda m: m.bitwiseAND(F.col("filter")) != 0
    early = lambda m: m.bitwiseAND(F.col("before")) != 0

    def over(label: str, weight) -> Column:
        return F.aggregate(_range(), F.lit(0).cast("long"), lambda so_far, m: so_far + F.get(label, m) * weight(m))

    where = lambda test: F.when(test, 1).otherwise(0)
    removed = lambda m: where(fails(m) & ~early(m))
    turns = F.array(*(F.lit(len(ORDERS) // n if n else 0) for n in range(len(FILTERS) + 1)))
    return each.select(
        "part", "before", "filter",
        over("all", lambda m: where(~fails(m) & ~early(m))).alias("kept"),
        over("all", removed).alias("removed"),
        over("all", lambda m: where(fails(m) & early(m))).alias("redundant"),
        over("all", lambda m: where(m == F.col("filter"))).alias("unique_fails"),
        over("good", removed).alias("good_lost"),
        over("toxic", removed).alias("toxic_lost"),
        over("all", lambda m: F.when(fails(m), F.get(turns, F.bit_count(m))).otherwise(0)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    counts = cell_counts(parity_sums(masks(docs, labels)))
    bits = {letter: 1 << k for k, letter in enumerate(FILTERS)}
    plan = [(order, at + 1, sum(bits[c] for c in order[:at]), bits[letter]) for order in ORDERS for at, letter in enumerate(order)]
    orders = docs.sparkSession.createDataFrame(plan, "filter_order string, step int, before int, filter int")  # 600 rows, whatever the input
    return _steps(counts).join(F.broadcast(orders), ["before", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return filter_audit(docs, labels)


ORACLE_SQL = r"""
WITH flags AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), fails AS (
  SELECT t.part, coalesce(f.good, false) AS good, coalesce(f.toxic, false) AS toxic, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)
  ] AS failed
  FROM texts t LEFT JOIN flags f ON t.doc_id = f.doc_id
), grouped AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY ALL
), letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS l
), orders AS (
  SELECT [a.l, b.l, c.l, d.l, e.l] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT o, s AS step, o[s] AS l, o[1:s - 1] AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), marked AS (
  SELECT g.*, st.*, g.failed[st.l] AS fails_it, len(list_filter(st.earlier, lambda x: g.failed[x])) > 0 AS gone, len(list_filter(g.failed, lambda x: x)) AS n_failed
  FROM grouped g, steps st
), counted AS (
  SELECT part, o, step, l,
    sum(n) FILTER (NOT gone AND NOT fails_it) AS kept, sum(n) FILTER (NOT gone AND fails_it) AS removed, sum(n) FILTER (gone AND fails_it) AS redundant,
    sum(n) FILTER (fails_it AND n_failed = 1) AS unique_fails, sum(good) FILTER (NOT gone AND fails_it) AS good_lost, sum(toxic) FILTER (NOT gone AND fails_it) AS toxic_lost
  FROM marked GROUP BY ALL
)
SELECT part, array_to_string(list_transform(o, lambda x: 'ABCDE'[x]), '') AS filter_order, step::INTEGER AS step,
  coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM counted
"""
