"""Semantic splitting: sentences are grouped where the likeness of neighbours dips."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lodegraph.operators.chunking import MAX_CHARS, OVERLAP, split_text
from lodegraph.plugins import Embedder, HashingEmbedder


SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
LEAST_SENTENCES, DIP_PERCENTILE, MIN_DISTANCE, OVERSIZE = 4, 0.2, 2, 1.5
#: First derivative of a smoothing cubic over five points.
_SLOPE = np.array([1, -8, 0, 8, -1]) / 12


def nearest_rank(values: list[float], p: float) -> float:
    """The element at floor(p n) of the sorted values, not interpolated."""
    ordered = sorted(values)
    return ordered[min(int(p * len(ordered)), len(ordered) - 1)]


def thinned(positions: list[int], least: int = MIN_DISTANCE) -> list[int]:
    out: list[int] = []
    for p in positions:
        if not out or p - out[-1] >= least:
            out.append(p)
    return out


def boundaries(likeness: list[float]) -> list[int]:
    """Sentences that begin a group: minima of the smoothed likeness below its 20th percentile; of few values those after the lowest ones."""
    if not likeness:
        return []
    floor = nearest_rank(likeness, DIP_PERCENTILE)
    if len(likeness) < 5:
        return thinned([i + 1 for i, s in enumerate(likeness) if s < floor])
    values = np.array(likeness)
    edge = [np.polyder(np.polyfit(np.arange(5), part, 3)) for part in (values[:5], values[-5:])]  # at the ends the nearest five points decide
    slope = np.concatenate([np.polyval(edge[0], [0, 1]), np.convolve(values, _SLOPE[::-1], mode="valid"), np.polyval(edge[1], [3, 4])])
    slope[np.abs(slope) < 1e-12] = 0.0
    return thinned([i for i in range(1, len(slope)) if slope[i - 1] < 0 <= slope[i] and likeness[i] < floor])


def grouped(sentences: list[str], at: list[int]) -> list[str]:
    cuts = [0, *[b for b in at if 0 < b < len(sentences)], len(sentences)]
    return [" ".join(sentences[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]


def semantic_split(text: str, embedder: Embedder, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Groups of sentences; a short text or one whose embedding fails is split recursively, as is a group far too long."""
    sentences = [s for s in (x.strip() for x in SENTENCE_END.split(text)) if s]
    if len(sentences) < LEAST_SENTENCES:
        return split_text(text, most, overlap)
    try:
        v = np.asarray(embedder.embed(sentences))
    except Exception:  # noqa: BLE001  any failure of a plug-in
        return split_text(text, most, overlap)
    norms = np.linalg.norm(v, axis=1)
    dots = (v[1:] * v[:-1]).sum(1)
    both = norms[1:] * norms[:-1]
    likeness = np.where(both > 0, dots / np.where(both > 0, both, 1), 0.0).tolist()
    out: list[str] = []
    for group in grouped(sentences, boundaries(likeness)):
        out += split_text(group, most, overlap) if len(group) > OVERSIZE * most else [group]
    return out or split_text(text, most, overlap)


def semantic_chunks(docs: DataFrame, embedder: Embedder | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, content)."""
    made = embedder or HashingEmbedder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, piece) for i, t in batch.itertuples(index=False) for n, piece in enumerate(semantic_split(t or "", made))]
            yield pd.DataFrame(rows, columns=[id_col, "pos", "content"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, pos int, content string")
