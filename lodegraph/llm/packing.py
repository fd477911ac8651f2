"""Hierarchical packing of token sequences into windows of several lengths.

A document is its tokens under a byte-level BPE vocabulary, then an end token. Documents are routed to tiers, the window
lengths (powers of two, the longest last):

* whole windows of the longest tier are cut from long documents; what is left goes on as a shorter document;
* a document waits in the shortest tier that holds it, uncut; one that fills its tier exactly is a window at once;
* a tier in which more than its part of ``most_open`` documents wait packs a window: one of its own documents (several in
  the shortest tier), then whole documents of shorter tiers for the gap, and at last a cut of another document of its own,
  whose rest goes on in the tier of its length;
* a tier gives no more tokens to longer windows' gaps than it has received as rests of cut documents, so each tier packs as
  many tokens into windows of its own as were routed to it.

Each partition packs what it reads, in the order in which it reads it, so nothing is shuffled, memory is bounded by
``most_open`` documents of less than a window (128 a tier at least) and one more, and a lost task is simply run again. Only a
partition's last window is padded. Windows of all tiers are dealt to step groups of ``step_tokens`` tokens: a window goes to the first open
group with room for it, and as lengths divide each other, few groups are open at a time and all but a partition's last
one are full. Steps of full groups have equal work, whatever tiers they mix.

One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (length of its window),
step_group. Defined results: a null or empty text is the end token alone; repeated rows are packed each on their own
(their pieces carry equal doc_ids); a null doc_id stays null; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_batches
from .vocab import encoding, path_of

TIERS = (128, 256, 512, 1024)
MOST_OPEN = 512
#: Documents of a tier that are looked at for one that fits a gap.
LOOK = 8
STEP_TOKENS = 8192
END_ID = 0
VOCABULARY = "byte_bpe_50k"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@cache
def tokenizer(name: str = VOCABULARY) -> Callable[[str], np.ndarray]:
    """Ids of a text: those of the vocabulary's tokenizers file with add_special_tokens=False.

    The same vocabulary as tiktoken ranks gives the same ids several times faster; the file's special tokens are split
    off first, as the tokenizers library does. ``tests/llm`` hold the two against each other.
    """
    found = encoding(path_of(f"{name}.tiktoken"))
    every = found.special_tokens_set

    def ids(text: str) -> np.ndarray:
        return np.array(found.encode(text, allowed_special=every, disallowed_special=()), dtype="<u4")

    return ids


class Packer:
    """Packs one partition's documents; ``rows`` are the pieces of the step groups closed so far."""

    def __init__(self, first_id: int, tiers: tuple[int, ...] = TIERS, most_open: int = MOST_OPEN, step_tokens: int = STEP_TOKENS):
        self.tiers, self.most_open, self.step_tokens = sorted(tiers), most_open, step_tokens
        if any(t & (t - 1) for t in self.tiers) or step_tokens % self.tiers[-1]:
            raise ValueError("tiers are powers of two and a step holds whole windows of the longest")
        self.next_id = self.next_group = first_id
        self.waiting: dict[int, deque[tuple]] = {t: deque() for t in self.tiers}
        self.tokens = dict.fromkeys(self.tiers, 0)  # that wait in each tier
        self.spare = dict.fromkeys(self.tiers, 0)  # rests received less what was given to longer windows
        self.most = max(2, most_open // len(self.tiers))
        self.steps: dict[int, tuple[int, list]] = {}  # open step groups: their room and windows
        self.rows: list[tuple] = []

    @property
    def held(self) -> int:
        return sum(map(len, self.waiting.values()))

    @property
    def held_tokens(self) -> int:
        return sum(self.tokens.values())

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, at, longest = len(ids), 0, self.tiers[-1]
        while total - at >= longest:
            self._close(longest, [(doc_id, at, ids[at : at + longest], total)])
            at += longest
        if at < total:
            self._wait((doc_id, at, ids[at:].copy() if at else ids, total))  # a copy lets go of a long document
        self._pack_while(self.most)

    def _pack_while(self, more: int) -> None:
        """Packs tiers in which more than so many documents wait, the longest first; rests only go to shorter tiers or stay."""
        for tier in reversed(self.tiers):
            while len(self.waiting[tier]) > more and self.tokens[tier] >= tier:
                self._pack(tier)

    def _wait(self, piece: tuple, rest_of: int = 0) -> None:
        n = len(piece[2])
        tier = next(t for t in self.tiers if t >= n)
        if n == tier:
            self._close(tier, [piece])
            return
        self.waiting[tier].append(piece)
        self.tokens[tier] += n
        if tier < rest_of:
            self.spare[tier] += n

    def _next(self, tier: int) -> tuple:
        piece = self.waiting[tier].popleft()
        self.tokens[tier] -= len(piece[2])
        return piece

    def _fitting(self, tier: int, gap: int, most: int) -> tuple | None:
        """One of the tier's first documents that fits the gap and ``most``, whole."""
        queue = self.waiting[tier]
        for _ in range(min(LOOK, len(queue))):
            if len(queue[0][2]) <= min(gap, most):
                return self._next(tier)
            queue.rotate(-1)
        return None

    def _pack(self, tier: int) -> None:
        """A full window of a tier in which at least as many tokens wait."""
        pieces = [self._next(tier)]
        gap = tier - len(pieces[0][2])
        for source in reversed(self.tiers[: self.tiers.index(tier) + 1]):
            own = source == tier
            while gap > (source // 2 if source > self.tiers[0] else 0) and (piece := self._fitting(source, gap, gap if own else self.spare[source])):
                pieces.append(piece)
                gap -= len(piece[2])
                self.spare[source] -= 0 if own else len(piece[2])
        while gap:
            doc_id, start, ids, total = self._next(tier)
            if len(ids) > gap:
                self._wait((doc_id, start + gap, ids[gap:], total), tier)
                ids = ids[:gap]
            pieces.append((doc_id, start, ids, total))
            gap -= len(ids)
        self._close(tier, pieces)

    def _take(self, n: int) -> list:
        """Pieces of n ids in all from the shortest tiers, the last one cut if need be."""
        out = []
        while n:
            doc_id, start, ids, total = self._next(next(t for t in self.tiers if self.waiting[t]))
            if len(ids) > n:
                self._wait((doc_id, start + n, ids[n:], total))
                ids = ids[:n]
            out.append((doc_id, start, ids, total))
            n -= len(ids)
        return out

    def _close(self, tier: int, pieces: list) -> None:
        """Numbers a window and deals it to a step group; only the partition's last may be shorter than its tier."""
        at, window = 0, []
        for doc_id, start, ids, total in pieces:
            window.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, at, tier))
            at += len(ids)
        self.next_id += 1
        self._deal(tier, window)

    def _deal(self, tier: int, window: list) -> None:
        group = next((g for g, (room, _) in self.steps.items() if room >= tier), None)
        if group is None:
            group, self.next_group = self.next_group, self.next_group + 1
            self.steps[group] = (self.step_tokens, [])
        room, windows = self.steps[group]
        windows.append((tier, window))
        if room > tier:
            self.steps[group] = (room - tier, windows)
        else:
            self._write(group)

    def _write(self, group: int) -> None:
        for _, window in self.steps.pop(group)[1]:
            self.rows += [(*piece, group) for piece in window]

    def end(self) -> None:
        """Packs all that waits: each tier its own, and what is too little for a window of its own together, the last window padded."""
        self._pack_while(1)
        while self.held:
            tier = next((t for t in reversed(self.tiers) if t <= self.held_tokens), self.tiers[-1])
            self._close(tier, self._take(min(tier, self.held_tokens)))
        left = [w for _, windows in self.steps.values() for w in windows]
        self.steps.clear()
        for tier, window in sorted(left, key=lambda w: -w[0]):  # longest first: all groups but the last are filled
            self._deal(tier, window)
        for group in list(self.steps):
            self._write(group)

    def drain(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, vocabulary: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """One row per piece; sequence_ids and step groups are unique over partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 36, tiers)
        encode = tokenizer(vocabulary)
        end = np.array([END_ID], dtype="<u4")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, np.concatenate([encode(text.as_py() or ""), end]))
                if len(packer.rows) >= 10_000:
                    yield _batch(packer.drain())
        packer.end()
        yield _batch(packer.drain())

    return map_batches(docs.select("doc_id", text_col), run, SCHEMA)


def op3_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)
