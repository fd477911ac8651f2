"""Alignment of the tokens that two tokenizers make of the same texts.

Both tokenizers start a token at a single space between two words, so a text falls into segments that can be aligned on
their own, and most of them occur again and again. Texts are taken in blocks of about ``BLOCK_CHARS`` characters; a block's
distinct segments are tokenised once and aligned by relational steps:

1. tokens are exploded, each with its end in bytes, its id and its side in one integer;
2. tokens of both sides meet by equality of segment and end (the tokens of both sides are one table, already dealt by
   block, so this equi-join is a grouping by segment, end and side);
3. where tokens of both sides end, the text is cut; running counts of cuts are group ids;
4. the distinct ends cut the text into pieces of which each lies in one token of either side, and every overlapping pair
   shares exactly one piece: the pair is the nearest token of each side that ends there or later. These are the links that
   a range join of the tokens within groups would give, in time linear in the tokens.

A document is a list of references to segments of its block; its sums, its groups' text and its distinct pairs are put
together per block and saved as one row, pairs are counted over all documents, and the counts go back to the blocks: as a
broadcast if there are at most ``MOST_SHIPPED``, else by a join. A block is the most that one task holds: about
``BLOCK_CHARS`` characters or one longer text. References and segments are made by two passes over the texts, as keeping
both would take more room than the texts. A block's id holds a checksum of its references: if the passes see other rows or
another order, which a plain scan never does, blocks stay without their other half, and the job fails and says so.

Defined results: a null or empty text, or one whose tokens do not spell it, has no tokens and zeros; repeated rows are
documents of their own; a null doc_id stays null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, saved, trim
from .vocab import encoding, path_of

BLOCK_CHARS = 1 << 23
#: Pairs whose counts are broadcast, 24 bytes each.
MOST_SHIPPED = 4_000_000
VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: A space between two words; both tokenizers start a token there.
BOUNDARY = re.compile(r" (?<=\S )(?=\S)")
#: Fixed value: the mark of a space in pieces.
MARK = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Segments that are encoded by one call.
_AT_ONCE = 20_000
#: References whose groups are joined to text at once.
_SLICE = 100_000


@dataclass(frozen=True)
class Pieces:
    """A sentencepiece model with the bytes of its pieces; ``separable`` if no piece has a space after something else."""

    processor: object
    spelled: list[bytes]
    separable: bool


@cache
def pieces(path: str) -> Pieces:
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    spelled = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(n)) else n.replace(MARK, " ").encode() for n in names]
    return Pieces(processor, spelled, not any(MARK in n.lstrip(MARK) for n in names))


@cache
def byte_lengths(path: str) -> np.ndarray:
    """Bytes of each token of a file of ranks."""
    coder = encoding(path)
    lengths = np.zeros(coder.n_vocab, np.int64)
    for token in range(coder.n_vocab):
        try:
            lengths[token] = len(coder.decode_single_token_bytes(token))
        except KeyError:
            pass
    return lengths


def _packed(values: np.ndarray) -> bytes:
    """Integers below 2 ** 32, compressed by their bytes' places."""
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(n).astype(np.int64)


def id_bits(path_a: str, path_b: str) -> int:
    """Bits of an id of either vocabulary."""
    return max(len(byte_lengths(path_a)), len(pieces(path_b).spelled)).bit_length()


@dataclass(frozen=True)
class Encoded:
    """Runs of tokens of the segments that either side's tokens spell, ``sizes[i]`` of segment ``rows[i]``.

    A token is the low bits of its end, then its id, then whether it is of the first side: 31 bits in all. ``base[i]`` has
    the high bits of the run's ends, so that a long segment is several runs.
    """

    rows: np.ndarray
    base: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray


def encoded(segments: list[str], path_a: str, path_b: str) -> Iterator[Encoded]:
    """The tokens of each segment after a space, many segments at once."""
    coder, lengths, model = encoding(path_a), byte_lengths(path_a), pieces(path_b)
    lengths_b, width = np.fromiter(map(len, model.spelled), np.int64, len(model.spelled)), id_bits(path_a, path_b)
    low = 30 - width
    plain = [i for i, s in enumerate(segments) if not s[0].isspace() and not s[-1].isspace()]
    others = sorted(set(range(len(segments))).difference(plain))
    for run in [plain[k : k + _AT_ONCE] for k in range(0, len(plain), _AT_ONCE)] + [[i] for i in others]:
        chunk = [segments[i] for i in run]
        joined = " " + " ".join(chunk)
        data = joined.encode()
        stops = np.cumsum(np.fromiter((len(s.encode()) + 1 for s in chunk), np.int64, len(chunk)))
        a = np.array(coder.encode_ordinary(joined), np.int64)
        ends = np.cumsum(lengths[a])
        to_a = np.searchsorted(ends, stops) + 1
        if not len(a) or not np.array_equal(ends[np.minimum(to_a, len(a)) - 1], stops):
            raise ValueError("tokens of the first vocabulary cross a boundary of segments")
        lists = model.processor.encode(chunk, num_threads=1)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter(chain.from_iterable(lists), np.int64, int(n_b.sum()))
        sound = np.ones(len(run), bool)
        if b"".join([model.spelled[i] for i in b.tolist()]) != data:
            before = [0, *stops[:-1].tolist()]
            sound[:] = [b"".join([model.spelled[i] for i in x]) == data[k:m] for x, k, m in zip(lists, before, stops.tolist())]
        n_a = np.diff(to_a, prepend=0)
        starts = np.concatenate([[0], np.cumsum(n_a + n_b)[:-1]])
        ends_b = np.concatenate([[0], np.cumsum(lengths_b[b])])
        at_a, at_b = _ranges(starts, n_a), _ranges(starts + n_a, n_b)
        end, tokens = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
        end[at_a], end[at_b] = ends - np.repeat(stops - np.diff(stops, prepend=0), n_a), ends_b[1:] - np.repeat(ends_b[np.cumsum(n_b) - n_b], n_b)
        tokens[at_a], tokens[at_b] = a << 1 | 1, b << 1
        tokens |= (end & ((1 << low) - 1)) << (width + 1)
        segment, high = np.repeat(np.arange(len(run)), n_a + n_b), end >> low
        if not sound.all():
            kept = sound[segment]
            tokens, segment, high = tokens[kept], segment[kept], high[kept]
        new = np.flatnonzero(np.diff(segment, prepend=-1) | np.diff(high, prepend=-1))
        yield Encoded(np.array(run, np.int32)[segment[new]], high[new].astype(np.int32), np.diff(new, append=len(tokens)), tokens.astype(np.int32))


def _blocks(batches: Iterator[pa.RecordBatch], split, block_chars: int) -> Iterator[tuple[int, list, list[np.ndarray], dict[str, int]]]:
    """(block, ids, references, segments) of the rows of one task; a block's id is made of the task's place, its own and a checksum."""
    first = TaskContext.get().partitionId() << 12
    ids, refs, known, size, seen = [], [], {}, 0, 0
    for batch in batches:
        for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = value.as_py()
            parts = split(text) if text else []
            ids.append(doc_id)
            refs.append(np.fromiter((known.setdefault(s, len(known)) for s in parts), np.int32, len(parts)))
            seen = crc32(refs[-1].tobytes(), seen)
            size += len(text or "") + 1
            if size >= block_chars and (first + 1) % 4096:
                yield first << 27 | seen >> 5, ids, refs, known
                first, ids, refs, known, size, seen = first + 1, [], [], {}, 0, 0
    if ids:
        yield first << 27 | seen >> 5, ids, refs, known


def _picked(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _splitter(separable: bool):
    return BOUNDARY.split if separable else (lambda text: [text])


def references(docs: DataFrame, text_col: str, path_b: str, block_chars: int) -> DataFrame:
    """block, row, doc_id, n and its n references to segments, packed."""
    separable = pieces(path_b).separable

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, refs, _ in _blocks(batches, _splitter(separable), block_chars):
            for k in range(0, len(ids), 1000):
                part = refs[k : k + 1000]
                n = len(part)
                columns = [pa.array([block] * n, pa.int64()), pa.array(range(k, k + n), pa.int32()), pa.array(ids[k : k + n], pa.int64()), pa.array([len(r) for r in part], pa.int32()), pa.array([_packed(r) for r in part], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "row", "doc_id", "n", "refs"])

    return map_batches(_picked(docs, text_col), run, "block long, row int, doc_id long, n int, refs binary")


def segments(docs: DataFrame, text_col: str, path_a: str, path_b: str, block_chars: int) -> DataFrame:
    """block, row, base, tokens: the runs of ``Encoded``."""
    separable = pieces(path_b).separable

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, known in _blocks(batches, _splitter(separable), block_chars):
            for e in encoded(list(known), path_a, path_b):
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(e.sizes)]), pa.int32()), pa.array(e.tokens, pa.int32()))
                n = len(e.rows)
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array(e.rows, pa.int32()), pa.array(e.base, pa.int32()), tokens], names=["block", "row", "base", "tokens"])
        for held in (pieces, byte_lengths, encoding):  # workers live on, and the next steps need no vocabulary
            held.cache_clear()

    return map_batches(_picked(docs, text_col), run, "block long, row int, base int, tokens array<int>")


def segment_links(found: DataFrame, width: int) -> DataFrame:
    """block, at, code: the links of each segment by the ends where they are found; ``at``: segment and end.

    A code holds the ids of both sides and in its last bits whether the first or the second side's token ends there; both
    do at the end of a group. Blocks are dealt to more tasks than usual, as the steps hold a task's tokens at once.
    """
    tasks = 4 * int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartition(tasks, "block").select("block", "row", "base", F.explode("tokens").alias("token"))
    end = F.shiftleft("base", 30 - width).bitwiseOR(F.shiftright("token", width + 1))
    tokens = dealt.select("block", "row", end.alias("end"), F.shiftright("token", 1).bitwiseAND(F.lit((1 << width) - 1)).alias("id"), (F.col("token") % 2).alias("first"))
    of = lambda first: F.max(F.when(F.col("first") == first, F.col("id")))
    met = tokens.groupBy("row", "block", "end").agg(of(1).alias("a"), of(0).alias("b"))
    onward = Window.partitionBy("row", "block").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nearest = lambda side: F.last(side, ignorenulls=True).over(onward).cast("long")
    ends = F.col("a").isNotNull().cast("long") + 2 * F.col("b").isNotNull().cast("long")
    code = F.shiftleft(nearest("a"), 26).bitwiseOR(F.shiftleft(nearest("b"), 2)).bitwiseOR(ends)
    return met.select("block", F.shiftleft(F.col("row").cast("long"), 32).bitwiseOR(F.col("end").cast("long")).alias("at"), code.alias("code"))


#: A block: its documents in order (refs: all references), the number of links of each segment, their pairs by place in ``pairs``.
BLOCK = "block long, doc_id array<long>, n array<int>, refs binary, per binary, n_segments int, pair_of binary, n_links int, pairs array<long>, n_docs array<long>, a array<long>, b array<long>, groups array<long>, links array<long>, digests array<string>"
_FIELDS = [c.split() for c in BLOCK.split(", ")]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def _joined(lists: np.ndarray, values: pa.Array, by: str) -> pa.Array:
    """Strings of each list, joined; ``lists``: how many values each has."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists)]), pa.int32()), values), by)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the values between the starts, of which the last is the end of all."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All integers of the ranges that begin at ``starts``."""
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(len(shift)) + shift


def _ordered(links: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Segment and code of each link, by segment and end."""
    at = links.column("at").to_numpy()
    order = np.argsort(at)
    return (at[order] >> 32).astype(np.int32), links.column("code").to_numpy()[order]


def _group_texts(code: np.ndarray, groups_of: np.ndarray) -> pa.Array:
    """The text of each segment's groups."""
    ends_a, ends_b = code & 1 == 1, code & 2 == 2
    of_group = np.cumsum(ends_a & ends_b, dtype=np.int32)  # groups that have ended with each link
    n_groups = int(of_group[-1]) if len(code) else 0
    of_group -= ends_a & ends_b

    def side(shift: int, ends: np.ndarray) -> pa.Array:
        ids = (code[ends] >> shift & 0xFFFFFF).astype(np.int32)
        return _joined(np.bincount(of_group[ends], minlength=n_groups), pa.array(ids).cast(pa.string()), ",")

    return _joined(groups_of, pc.binary_join_element_wise(side(26, ends_a), side(2, ends_b), "|"), ";")


def put_together(links: pa.Table, docs: pa.Table) -> pa.Table:
    """One block: its documents, its pairs and in how many of its documents they are."""
    docs = docs.sort_by("row")
    if not docs.num_rows:
        raise RuntimeError("two passes over the documents saw other rows or another order: save the documents before they are aligned")
    rows, code = _ordered(links)
    ns = docs.column("n").to_numpy()
    each = [_unpacked(data, n).astype(np.int32) for data, n in zip(docs.column("refs").to_pylist(), ns.tolist())]
    n_segments = 1 + max([int(rows.max(initial=-1)), *(int(r.max(initial=-1)) for r in each)])
    per, groups_of = np.bincount(rows, minlength=n_segments), np.bincount(rows[code & 3 == 3], minlength=n_segments)
    sound = per > 0  # of other segments the tokens do not spell them
    each = [r if not len(r) or sound[r].all() else r[:0] for r in each]
    at, refs = np.concatenate([[0], np.cumsum([len(r) for r in each])]).astype(np.int64), np.concatenate([np.zeros(0, np.int32), *each])
    del rows, each  # two blocks may be in an executor at once

    starts = np.concatenate([[0], np.cumsum(per)])
    texts = _group_texts(code, groups_of)
    trim()
    pairs, pair_of = np.unique(code >> 2, return_inverse=True)
    pair_of, ends_a, ends_b = pair_of.astype(np.int32), code & 1 == 1, code & 2 == 2
    del code
    sums = {name: _sums(x[refs], at) for name, x in (("a", _sums(ends_a, starts)), ("b", _sums(ends_b, starts)), ("groups", groups_of), ("links", per))}
    digests, counts = [], np.zeros(len(pairs), np.int64)
    low = 0
    while low < docs.num_rows:  # a few documents at once: their groups' texts are long
        high = max(low + 1, int(np.searchsorted(at, at[low] + _SLICE, "right")) - 1)
        joined = _joined(np.diff(at[low : high + 1]), texts.take(pa.array(refs[at[low] : at[high]])), ";")
        digests += [sha256(x.encode()).hexdigest() if x else "" for x in joined.to_pylist()]
        for doc in range(low, high):
            own = np.unique(refs[at[doc] : at[doc + 1]])
            counts[np.unique(pair_of[_ranges(starts[own], per[own])])] += 1
        low = high
    trim()
    made = sums | {
        "block": docs.column("block")[0].as_py(), "doc_id": docs.column("doc_id").combine_chunks(), "n": np.diff(at), "refs": _packed(refs), "per": _packed(per), "n_segments": n_segments,
        "pair_of": _packed(pair_of), "n_links": len(pair_of), "pairs": pairs, "n_docs": counts, "digests": digests,
    }
    return pa.table([pa.array([made[name]], _TYPES[kind]) if not isinstance(made[name], pa.Array) else pa.ListArray.from_arrays(pa.array([0, len(made[name])], pa.int32()), made[name]) for name, kind in _FIELDS], names=[name for name, _ in _FIELDS])


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _priced(block: dict, counts: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """The documents of one block, given the count of each of its pairs and whether it is its first id's best."""
    at = np.concatenate([[0], np.cumsum(np.asarray(block["n"].values))]).astype(np.int64)
    refs = _unpacked(block["refs"].as_py(), int(at[-1]))
    starts = np.concatenate([[0], np.cumsum(_unpacked(block["per"].as_py(), block["n_segments"].as_py()))])
    pair_of = _unpacked(block["pair_of"].as_py(), block["n_links"].as_py())
    sums = [pa.array(_sums(_sums(x[pair_of], starts)[refs], at), pa.int64()) for x in (best.astype(np.int64), counts)]
    return pa.RecordBatch.from_arrays([*(block[c].values for c in ("doc_id", "a", "b", "groups", "links")), *sums, block["digests"].values], names=[c.split()[0] for c in RESULT.split(", ")])


def _by_broadcast(made: DataFrame, counted: DataFrame) -> DataFrame:
    found = counted.orderBy("code").toArrow()
    codes, totals, best = (found.column(c).to_numpy() for c in ("code", "total", "best"))
    shipped = made.sparkSession.sparkContext.broadcast((codes, totals, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, totals, best = shipped.value
        for batch in batches:
            for i in range(batch.num_rows):
                block = {name: batch.column(name)[i] for name in batch.schema.names}
                places = np.searchsorted(codes, block["pairs"].values.to_numpy(zero_copy_only=False))
                yield _priced(block, totals[places], best[places])

    return map_batches(made, run, RESULT)


def _by_join(made: DataFrame, counted: DataFrame) -> DataFrame:
    prices = made.select("block", F.posexplode("pairs").alias("row", "code")).join(counted, "code").select("block", "row", "total", "best")

    def run(prices: pa.Table, blocks: pa.Table) -> pa.Table:
        prices = prices.sort_by("row")
        block = {name: blocks.column(name)[0] for name in blocks.schema.names}
        return pa.Table.from_batches([_priced(block, prices.column("total").to_numpy(), prices.column("best").to_numpy())])

    return prices.groupBy("block").cogroup(made.withColumn("block", F.col("block") + 0).groupBy("block")).applyInArrow(run, RESULT)


@dataclass(frozen=True)
class Alignment:
    """``documents``: a row per document; ``pairs``: a, b, n_docs and best (1 where no pair of the same a has more)."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, text_col: str = "text", block_chars: int = BLOCK_CHARS, most_shipped: int = MOST_SHIPPED) -> Alignment:
    """``path_a``: a file of tiktoken ranks; ``path_b``: a sentencepiece model; every executor can read them."""
    path_a, path_b = path_a or path_of(VOCABULARY_A), path_b or path_of(VOCABULARY_B)
    links = segment_links(segments(docs, text_col, path_a, path_b, block_chars), id_bits(path_a, path_b))
    texts = references(docs, text_col, path_b, block_chars)
    made = saved(links.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(put_together, BLOCK), "alignment-blocks")
    totals = made.select(F.inline(F.arrays_zip("pairs", "n_docs"))).groupBy(F.col("pairs").alias("code")).agg(F.sum("n_docs").alias("total"))
    most = Window.partitionBy(F.shiftright("code", 24))
    counted = saved(totals.withColumn("best", (F.col("total") == F.max("total").over(most)).cast("long")), "alignment-pairs")
    documents = (_by_broadcast if counted.count() <= most_shipped else _by_join)(made, counted)
    pairs = counted.select(F.shiftright("code", 24).alias("a"), F.col("code").bitwiseAND(F.lit(0xFFFFFF)).alias("b"), F.col("total").alias("n_docs"), "best")
    return Alignment(documents, pairs)


def op13_token_alignment(docs: DataFrame) -> DataFrame:
    return align(docs).documents
