"""Mixing sources to target weights, cut at each source's exact budget.

Sources in the order of their code points, null last, weigh 3, 1, 2, repeating. Together they get ``share`` of all words.
A source's target stops at ``most_epochs`` times its size; the excess goes to the others by weight until none is above.

Within a source documents are ordered by a hash-random key. The order is dealt out by ranges of the key, each range is
sorted and summed on its own, and the ranges' totals give each document the words before it. A source repeats its order
in whole epochs and is cut within the last, so the words taken equal the target rounded down; the document at the cut is
taken in part. A range of the key has about ``rows_per_range`` rows whatever the size of the source; no task has a source.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its own; repeated rows are
documents of their own (rows alike in every respect are interchangeable); a source whose size is 0 has target 0; extra
columns are ignored; an empty table gives an empty result. Reruns agree, as nothing depends on partitions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, saved, unused

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
ROWS_PER_RANGE = 20_000
#: Up to so many sources, targets are found on the driver and broadcast; of more, by aggregate passes, with the same results.
MAX_SOURCES = 100_000
SEED = 20_240_607
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS) -> dict[str | None, float]:
    """Water-filling: target words per source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    weight = dict(zip(order, cycle(weights)))
    cap = {s: most_epochs * sizes[s] for s in order}
    left, open_ = share * sum(sizes.values()), list(order)
    out: dict[str | None, float] = {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > cap[s]]
        if not above:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in above:
            out[s] = float(cap[s])
        left -= sum(cap[s] for s in above)
        open_ = [s for s in open_ if s not in out]
    return out


def ranked(sources: DataFrame) -> DataFrame:
    """Distinct sources with their place in the order of code points, null last: ranges sorted apart, with the sizes of those before."""
    order = [F.col("s").isNull(), F.col("s")]
    dealt = saved(sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "mix-sources")
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    before, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, before))
        before += sizes[part]
    starts = F.broadcast(sources.sparkSession.createDataFrame(rows, "_part int, _start long"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_start") - 1
    return dealt.join(starts, "_part").withColumn("place", place).drop("_part", "_start")


def spread_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """``targets`` for sources (s, source_size) of any number: adds target; a round of water-filling is an aggregate pass."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = saved(ranked(sources).withColumn("weight", weight).drop("place"), "mix-weights")
    cap = F.col("source_size") * F.lit(most_epochs)
    first = placed.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w"), F.count("*").alias("open")).first()
    left, total, count, closed = share * first["n"], first["w"], first["open"], F.lit(False)
    while count:
        above = ~closed & (F.lit(float(left)) * F.col("weight") / F.lit(float(total)) > cap)
        got = placed.agg(F.sum(F.when(above, F.col("source_size"))).alias("n"), F.sum(F.when(~closed & ~above, F.col("weight"))).alias("w"), F.count_if(above).alias("above")).first()
        if not got["above"]:
            break
        left, total, count = left - most_epochs * got["n"], got["w"], count - got["above"]
        closed = closed | above
    level = F.lit(float(left)) * F.col("weight") / F.lit(float(total or 1))
    return saved(placed.select("*", F.when(closed, cap.cast("double")).otherwise(level).alias("target")).drop("weight"), "mix-targets")


def with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the columns of their source: sources of several ranges, of which there are few, are broadcast; the rest meet by source."""
    same = F.col("source").eqNullSafe(F.col("s"))
    large = F.broadcast(sources.where("n_ranges > 1"))
    small = rows.join(large, same, "left_anti").join(sources.where("n_ranges = 1").hint("merge"), same)
    return rows.join(large, same).unionByName(small)


def sized(docs: DataFrame, text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """doc_id, source, size in words and the random key of each row, written out once."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce(F.col(text_col), F.lit("")))
    return saved(docs.select("doc_id", F.col(source_col).alias("source"), size.alias("size"), key.alias("key")), "mix-sized")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS, rows_per_range: int = ROWS_PER_RANGE, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, key, words_before and taken of each row."""
    spark = docs.sparkSession
    rows = sized(docs, seed=seed)
    by_source = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs"))
    found = by_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        each = by_source.select(F.col("source").alias("s"), F.col("n").alias("source_size"), F.ceil(F.col("docs") / rows_per_range).alias("n_ranges"))
        met = with_sources(rows, spread_targets(each, weights, share, most_epochs))
    else:
        target = targets({r["source"]: r["n"] for r in found}, weights, share, most_epochs)
        plan = [(r["source"], r["n"], target[r["source"]], max(1, -(-r["docs"] // rows_per_range))) for r in found]
        sources = spark.createDataFrame(plan, "s string, source_size long, target double, n_ranges long")
        met = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s")))
    # A range of the key: its place among n_ranges equal parts of the 64-bit space.
    place = F.floor((F.shiftrightunsigned("key", 32).cast("double") / F.lit(float(1 << 32))) * F.col("n_ranges")).cast("long")
    signed = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))  # so that ranges and key agree in their order
    dealt = met.withColumns({"range": place, "key": signed}).drop("s")
    ranges = dealt.groupBy("source", "range").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select(F.col("source").alias("os"), F.col("range").alias("orange"), before.alias("offset"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = dealt.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = ordered.join(offsets, F.col("source").eqNullSafe(F.col("os")) & (F.col("range") == F.col("orange")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    words_before = F.col("_before") + F.col("offset")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - words_before))
    return placed.select("doc_id", "source", "size", "source_size", "target", "key", words_before.alias("words_before"), (epochs * F.col("size") + rest).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns; taken in part, its first words.

    Rows alike in id and text share what they take evenly.
    """
    key_name, taken_name, size_name = unused(docs.columns, "key", "taken", "size")
    plan = mix_sources(docs, weights, share, most_epochs, seed=seed).withColumn("key", F.col("key").bitwiseXOR(F.lit(-(1 << 63))))
    plan = plan.groupBy("key").agg(F.floor(F.sum("taken") / F.count("*")).cast("long").alias(taken_name), F.first("size").alias(size_name)).where(F.col(taken_name) > 0)
    names = docs.columns
    at, count_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def first_words(text: str, n: int) -> str:
        for i, m in enumerate(WORD.finditer(text), 1):
            if i == n:
                return text[: m.end()]
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, size = (np.array(batch.column(len(names) + k).to_pylist(), np.int64) for k in (0, 1))
            rows = pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names)
            if len(taken):
                yield rows.take(pa.array(np.repeat(np.arange(len(taken)), taken // np.maximum(size, 1))))
                cut = np.flatnonzero(taken % np.maximum(size, 1))
                part = rows.take(pa.array(cut))
                texts = [first_words(t, int(n)) for t, n in zip(part.column(at).to_pylist(), (taken % np.maximum(size, 1))[cut])]
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                if count_at is not None:
                    columns[count_at] = pa.array(list(map(len, texts)), part.column(count_at).type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))
    return map_batches(docs.withColumn(key_name, key).join(plan.withColumnRenamed("key", key_name), key_name).select(*names, taken_name, size_name), run, docs.schema)


def op2_mixing(docs: DataFrame) -> DataFrame:
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
