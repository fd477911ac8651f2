"""N-gram Jaccard join by PartEnum signatures.

Two documents link when 100 * |A and B| >= threshold * |A or B| over their sets of distinct 5-word shingles. Sets of sizes
a and b that link differ in at most k = (100 - t)(a + b) / (100 + t) elements. Sizes fall in bands that double; a pair
meets in the band of its larger set, so a set also signs for the next band if a set that it may link to lies there. In a
band the domain of shingle hashes is cut into n1 first-level parts of 3 second-level parts each, with n1 a little over half
the band's largest k. A signature is a first-level part with a subset of two of its second-level parts and what the set has
there. Some first-level part holds at most one difference, so at least one of its subsets is equal: with n1 parts to spare,
a linked pair has c = 2 n1 - k (3 n1 - 2 k for k <= n1) signatures in common, so the first 3 n1 - c + 1 of both under any one
order share one, and the rest need not be made. The order puts subsets with the most rare shingles first and those of
frequent shingles alone, and empty ones, last; frequent ones are found by a sketch that counts all documents. A signature
has about five shingles in common, so texts that merely share a passage seldom meet.

Documents of equal sets form a class, which signs once per partition. Classes that share a signature, directly or over
others, form a candidate group, so every link lies within one group. A group is dealt out in blocks of bounded size; first
each block, then, where a group of several blocks is not yet one component, each pair of blocks is one task's. There a
pair's unequal parts are counted, which cannot exceed the elements in which it differs, and the pairs that pass are
compared exactly, on whole texts, unless they are in one component by then. No link between components is lost, a group's
pairs are never rows, and a task returns no more links than join its components.

Words are compared by 64-bit hashes. Defined results: a null text, one without words: empty set, component of its own;
fewer than 5 words: the whole sequence is the one shingle; repeated rows are each reported, equal sets are linked; a null
doc_id stays null and gives its component no name; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import maybe_in
from .common import map_batches, saved, unused
from .components import connected_components

SHINGLE = 5
THRESHOLD = 80
#: Counters of the sketch of frequent shingles, as powers of two: as many as documents within these bounds. It only orders.
SKETCH_BITS, PIECES = (20, 22), 16
#: Second-level parts of a first-level part; a subset leaves one out.
SECOND = 3
LEAST_LEVEL = 6
#: Classes and shingles of a block, about.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 4_000_000

_U = np.uint64
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; words are split at ASCII white space, A-Z lower-cased."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, _U)
    w = np.fromiter(map(xxh3_64_intdigest, words), _U, n)
    if n < SHINGLE:
        return mixed((w * _MULTIPLIERS[:n]).sum(keepdims=True), n)
    total = w[: n - SHINGLE + 1] * _MULTIPLIERS[0]
    for k in range(1, SHINGLE):
        total = total + w[k : n - SHINGLE + 1 + k] * _MULTIPLIERS[k]
    return np.unique(mixed(total, SHINGLE))


def most_apart(a: int, b: int, threshold: int) -> int:
    """The most elements in which linked sets of these sizes differ."""
    return (100 - threshold) * (a + b) // (100 + threshold)


def level_of(size: int, threshold: int) -> int:
    """log2 of the parts by which sets of this size are compared before their elements are."""
    return max(LEAST_LEVEL, (2 * (most_apart(size, size, threshold) + 1) - 1).bit_length())


def first_parts(k: int) -> int:
    """First-level parts of a band whose sets differ in at most k elements."""
    return k // 2 + 1 + k // 16


def signatures(shingles: np.ndarray, frequent: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Signatures of a sorted set, as signed 64-bit values; none where only an equal set can link."""
    n = len(shingles)
    if not n:
        return np.empty(0, np.int64)
    largest = 100 * n // threshold
    content = rare = None
    out = []
    for band in range((n - 1).bit_length(), (largest - 1).bit_length() + 1):
        k = most_apart(n, min(largest, 1 << band), threshold)
        if not k:
            continue
        if content is None:
            content = mixed(shingles, 11)
            rare = (~frequent[(shingles & _U(len(frequent) - 1)).astype(np.int64)]).astype(np.int64)
        n1 = first_parts(most_apart(1 << band, 1 << band, threshold))
        parts = ((shingles >> _U(32)) * _U(SECOND * n1)) >> _U(32)
        at = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
        full = parts[at].astype(np.int64)
        sums, n_rare = np.zeros(SECOND * n1, _U), np.zeros(SECOND * n1, np.int64)
        sums[full], n_rare[full] = np.add.reduceat(content, at), np.add.reduceat(rare, at)
        sums, n_rare = mixed(sums, band).reshape(n1, SECOND), n_rare.reshape(n1, SECOND)
        place = np.arange(SECOND * n1, dtype=_U).reshape(n1, SECOND) * _MULTIPLIERS[0]
        made = mixed(np.roll(sums, 1, 1) * _MULTIPLIERS[1] + np.roll(sums, 2, 1) * _MULTIPLIERS[2] + place, band + 64).ravel()
        weak = (n_rare - n_rare.sum(1, keepdims=True)).ravel()  # minus the rare shingles of the two parts that are not left out
        common = SECOND * n1 - 2 * k if k <= n1 else 2 * n1 - k
        keep = SECOND * n1 - common + 1
        out.append(made if keep >= len(made) else made[np.lexsort((made, weak))[:keep]])
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def links(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether two sorted sets link."""
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)) or not len(a):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= threshold * (len(a) + len(b) - common)


_MEMBERS = "key long, doc_id long, n long, class long, piece int, slice int, counts binary"


def row_key(text_col: str) -> Column:
    return F.xxhash64(F.col("doc_id"), F.col(text_col))


def _class_of(shingles: np.ndarray) -> int:
    return int((mixed(shingles, 23).sum() + _U(len(shingles))).astype(np.int64)) if len(shingles) else 0


def _members_and_sketch(bits: int):
    names = [c.split()[0] for c in _MEMBERS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)

        def count(sets: list[np.ndarray]) -> None:
            if sets:
                places, n = np.unique(np.concatenate(sets) & _U(len(counts) - 1), return_counts=True)
                counts[places.astype(np.int64)] += n.astype(np.int32)

        for batch in batches:
            sizes, classes, waiting, ready = [], [], [], 0
            for text in batch.column(2).cast(pa.binary()):
                found = shingle_set(text.as_py())
                sizes.append(len(found))
                classes.append(_class_of(found))
                waiting.append(found)
                ready += len(found)
                if ready > 100_000:
                    count(waiting)
                    waiting, ready = [], 0
            count(waiting)
            n = batch.num_rows
            columns = [batch.column(0), batch.column(1).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        slice_ = TaskContext.get().partitionId() % 64
        pieces = np.split(counts.astype(np.int64), PIECES)
        columns = [[None] * PIECES] * 4 + [list(range(PIECES)), [slice_] * PIECES, [zlib.compress(p.tobytes(), 1) for p in pieces]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the counts of each piece, one row at a time."""
    total: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for piece, slice_, data in zip(*(c.to_pylist() for c in batch.columns)):
            counts = np.frombuffer(zlib.decompress(data), np.int64)
            total[piece, slice_] = total[piece, slice_] + counts if (piece, slice_) in total else counts
    keys = list(total)
    columns = [[k[0] for k in keys], [k[1] for k in keys], [zlib.compress(total[k].tobytes(), 1) for k in keys]]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], names=["piece", "slice", "counts"])


def _frequent(sketch: DataFrame, bits: int) -> bytes:
    """The packed bits of counters that stand out; the sketch's size has a bound."""
    schema = "piece int, slice int, counts binary"
    once = map_batches(sketch.repartition("piece", "slice"), _summed, schema)
    twice = map_batches(once.withColumn("slice", F.lit(0)).repartition("piece"), _summed, schema)
    counts = np.zeros(1 << bits, np.int64)
    for r in twice.collect():  # one row for each of PIECES
        width = len(counts) // PIECES
        counts[r["piece"] * width : (r["piece"] + 1) * width] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    usual = float(np.median(counts))
    return np.packbits(counts > usual + 8 * usual**0.5 + 30).tobytes()


def _signer(frequent: bytes, threshold: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(frequent, np.uint8)).astype(bool)
        seen: set[int] = set()
        for batch in batches:
            sigs, owners, ready = [], [], 0
            for text in batch.column(0).cast(pa.binary()):
                found = shingle_set(text.as_py())
                own = _class_of(found)
                if own in seen:
                    continue
                if len(seen) < 500_000:  # copies beyond are signed again, which costs time alone
                    seen.add(own)
                made = signatures(found, bits, threshold)
                if len(made):
                    sigs.append(made)
                    owners.append(np.full(len(made), own, np.int64))
                    ready += len(made)
                if ready >= 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(owners))], names=["sig", "class"])
                    sigs, owners, ready = [], [], 0
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(owners))], names=["sig", "class"])

    return sign


def unequal_parts(sets: list[np.ndarray], level: int) -> np.ndarray:
    """One byte per part and set: equal parts have equal bytes."""
    out = np.zeros((len(sets), 1 << level), np.uint8)
    for row, shingles in zip(out, sets):
        parts = (shingles >> _U(64 - level)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
        row[parts[at]] = (np.add.reduceat(mixed(shingles, 31), at) >> _U(56)).astype(np.uint8)
    return out


def linking_pairs(sets: list[np.ndarray], labels: list[int], blocks: list[int], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Pairs that link sets of different labels, as few as join them; of several blocks only pairs across are looked at."""
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes = [sets[i] for i in order], sizes[order]
    labels_, blocks_ = np.unique(np.array(labels, np.int64)[order], return_inverse=True)[1], np.array(blocks, np.int64)[order]
    across = len(np.unique(blocks_)) > 1
    levels = np.array([level_of(int(n), threshold) for n in sizes])
    lowest = np.searchsorted(sizes, -(-sizes * threshold // 100))  # the smallest set that each can link to
    out = []
    for level in np.unique(levels):
        mine = np.flatnonzero(levels == level)
        base = lowest[mine[0]]
        parts = unequal_parts(sets[base : mine[-1] + 1], int(level))
        for i in mine:
            low = lowest[i]
            may = labels_[low:i] != labels_[i]
            if across:
                may &= blocks_[low:i] != blocks_[i]
            near = low + np.flatnonzero(may)
            if not len(near):
                continue
            apart = (parts[near - base] != parts[i - base]).sum(1)
            for j in near[apart <= (100 - threshold) * (sizes[near] + sizes[i]) // (100 + threshold)]:
                if labels_[j] != labels_[i] and links(sets[i], sets[j], threshold):
                    out.append((int(order[i]), int(order[j])))
                    labels_[labels_ == labels_[j]] = labels_[i]
    return out


def _link_unit(threshold: int):
    def link(unit: pa.Table) -> pa.Table:
        classes = unit.column("class").to_pylist()
        sets = [shingle_set(t.as_py()) for t in unit.column("text").cast(pa.binary())]
        found = linking_pairs(sets, unit.column("label").to_pylist(), unit.column("block").to_pylist(), threshold)
        return pa.table({"a": pa.array([classes[i] for i, _ in found], pa.int64()), "b": pa.array([classes[j] for _, j in found], pa.int64())})

    return link


def _candidates(docs: DataFrame, frequent: bytes, threshold: int, text_col: str) -> DataFrame:
    """(class, least) of classes that share a signature with another: the least class of that signature."""
    signed = map_batches(docs.select(text_col), _signer(frequent, threshold), "sig long, class long")
    # Without this both uses below would each add their own null filter, and the signatures be made and shuffled twice.
    signed = signed.where("sig IS NOT NULL AND class IS NOT NULL").repartition("sig")
    shared = signed.groupBy("sig").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most").select("sig", "least")
    return saved(signed.join(shared.hint("shuffle_hash"), "sig").where("class <> least").select("class", "least").distinct(), "jaccard-candidates")


def _linked(units: DataFrame, keyed: DataFrame, threshold: int) -> DataFrame:
    """Links within units (grp, low, high; class, key, label, block)."""
    texts = keyed.where(maybe_in(units.select("key"), "key")).select("key", "text").dropDuplicates(["key"])
    rows = units.join(texts, "key").select("grp", "low", "high", "class", "label", "block", "text")
    return saved(rows.groupBy("grp", "low", "high").applyInArrow(_link_unit(threshold), "a long, b long"), "jaccard-links")


def jaccard_join(docs: DataFrame, threshold: int = THRESHOLD, text_col: str = "text") -> DataFrame:
    """key, doc_id, n_shingles, class and component_id of each row, and ``is_first``: one key of each component has it."""
    keyed = docs.select(row_key(text_col).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bits = min(max(docs.count().bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    scanned = saved(map_batches(keyed, _members_and_sketch(bits), _MEMBERS), "jaccard-members")
    members = scanned.where("piece IS NULL").select("key", "doc_id", "n", "class")
    frequent = _frequent(scanned.where("piece IS NOT NULL").select("piece", "slice", "counts"), bits)

    shared = _candidates(keyed, frequent, threshold, "text")
    groups = connected_components(shared.select(F.col("class").alias("a"), F.col("least").alias("b")))
    # One text stands for a class: the row with the least key.
    texts = members.where("n > 0").groupBy("class").agg(F.min("key").alias("key"), F.first("n").alias("n"))
    placed = texts.join(groups, F.col("class") == F.col("node")).select("class", "key", "n", F.col("component").alias("grp"))
    blocks = placed.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("n_blocks"))
    dealt = saved(placed.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("class"), F.col("n_blocks"))), "jaccard-blocks")
    inner = dealt.select("grp", F.col("block").alias("low"), F.col("block").alias("high"), "class", "key", F.col("class").alias("label"), "block")
    found = _linked(inner, keyed, threshold)
    components = connected_components(found)

    large = dealt.where("n_blocks > 1").join(components, F.col("class") == F.col("node"), "left").withColumn("label", F.coalesce("component", "class"))
    open_ = large.groupBy("grp").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("grp")
    large = saved(large.join(open_, "grp").select("grp", "block", "n_blocks", "class", "key", "label"), "jaccard-large")
    if not large.isEmpty():
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("other")
        outer = large.select("*", other).where("other <> block").withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        across = _linked(outer, keyed, threshold)
        components = connected_components(found.union(across))

    group = members.join(components, F.col("class") == F.col("node"), "left").select("key", "doc_id", "n", "class", F.coalesce("component", "class").alias("group"))
    full = group.where("n > 0")
    named = full.groupBy("group").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "key")).alias("first"))
    linked = full.join(named, "group").select("key", "doc_id", F.col("n").alias("n_shingles"), "class", "component_id", (F.col("key") == F.col("first.key")).alias("is_first"))
    alone = group.where("n = 0").select("key", "doc_id", F.col("n").alias("n_shingles"), "class", F.col("doc_id").alias("component_id"), F.lit(True).alias("is_first"))
    return linked.unionByName(alone)


def drop_copies(docs: DataFrame, threshold: int = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component is kept, with all their columns.

    The one with the smallest doc_id stays; documents without words all do. Rows that surely stay are not shuffled.
    """
    found = saved(jaccard_join(docs, threshold, text_col).select("key", "n_shingles", "is_first"), "jaccard-first")
    gone = found.where("NOT is_first").select("key").distinct()
    again = found.where("is_first AND n_shingles > 0").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    asked = saved(gone.union(again), "jaccard-gone")
    name, twice = unused(docs.columns, "row_key", "again")
    keyed = docs.withColumn(name, row_key(text_col))
    may = maybe_in(asked.select(F.col("key").alias(name)), name)
    gone = gone.select(F.col("key").alias(name))
    looked = keyed.where(may).join(gone, name, "left_anti").join(again.select(F.col("key").alias(name), F.lit(True).alias(twice)), name, "left")
    once = looked.where(F.col(twice)).dropDuplicates([name])
    return keyed.where(~may).select(*docs.columns).union(looked.where(F.col(twice).isNull()).select(*docs.columns)).union(once.select(*docs.columns))


def op7_partenum(docs: DataFrame) -> DataFrame:
    return jaccard_join(docs).select("doc_id", "n_shingles", "component_id")
