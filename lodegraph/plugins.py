"""Plug-in points: embedders, rerankers, language models, extractors, with deterministic offline defaults.

A plug-in is a plain object with one method that works on a batch, so that Spark calls it once per Arrow batch on the
executors; whatever it loads, it loads there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import text as T


class Embedder(Protocol):
    signature: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class LanguageModel(Protocol):
    def answer(self, prompts: list[str]) -> list[str]: ...


class HashingEmbedder:
    """Signed hashed token counts, scaled to length one; the same text always has the same vector."""

    def __init__(self, size: int = 64):
        self.size, self.signature = size, f"hashing:{size}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts):
            for token in re.findall(T.TOKEN, (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
                row[h % self.size] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


class OverlapReranker:
    """Share of the query's tokens that a text has."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        asked = set(re.findall(T.TOKEN, (query or "").lower()))
        return [len(asked & set(re.findall(T.TOKEN, (t or "").lower()))) / max(1, len(asked)) for t in texts]


class ExtractiveModel:
    """Answers with the start of what it is given."""

    def __init__(self, most_chars: int = 2000):
        self.most_chars = most_chars

    def answer(self, prompts: list[str]) -> list[str]:
        return [(p or "")[: self.most_chars] for p in prompts]


class Registry:
    """Named factories of one kind of plug-in."""

    def __init__(self, kind: str):
        self.kind, self._makers = kind, {}

    def register(self, name: str):
        def add(maker: Callable[..., Any]):
            if name in self._makers:
                raise ValueError(f"{self.kind} {name} is registered twice")
            self._makers[name] = maker
            return maker

        return add

    def make(self, name: str, **settings: Any) -> Any:
        if name not in self._makers:
            raise KeyError(f"no {self.kind} named {name}; known: {', '.join(sorted(self._makers))}")
        return self._makers[name](**settings)

    def names(self) -> list[str]:
        return sorted(self._makers)


EMBEDDERS, RERANKERS, MODELS = Registry("embedder"), Registry("reranker"), Registry("model")
EMBEDDERS.register("hashing")(HashingEmbedder)
RERANKERS.register("overlap")(OverlapReranker)
MODELS.register("extractive")(ExtractiveModel)


class Hooks:
    """Callbacks by event, called in the order in which they were added; one that fails does not stop the rest."""

    def __init__(self):
        self._calls: dict[str, list[Callable[..., Any]]] = {}

    def on(self, event: str, call: Callable[..., Any]) -> None:
        self._calls.setdefault(event, []).append(call)

    def fire(self, event: str, **values: Any) -> list[Exception]:
        failed = []
        for call in self._calls.get(event, []):
            try:
                call(**values)
            except Exception as error:  # noqa: BLE001  a hook is foreign code
                failed.append(error)
        return failed


def with_embeddings(frame: DataFrame, embedder: Embedder, text_col: str = "text", out: str = "embedding") -> DataFrame:
    @F.pandas_udf("array<double>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(list(embedder.embed(batch.fillna("").tolist())), index=batch.index)

    return frame.withColumn(out, embed(F.col(text_col)))


def reused_embeddings(chunks: DataFrame, prior: DataFrame, embedder: Embedder, size: int, text_col: str = "text") -> DataFrame:
    """Vectors of chunks by content hash from ``prior`` (content_sha, embedding) where they have the right size, else fresh ones."""
    keyed = chunks.withColumn("content_sha", T.content_sha(F.coalesce(F.col(text_col), F.lit(""))))
    held = prior.where(F.size("embedding") == size).select("content_sha", F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["content_sha"])
    old = keyed.join(held, "content_sha").withColumn("reused", F.lit(True))
    new = with_embeddings(keyed.join(held, "content_sha", "left_anti"), embedder, text_col).withColumn("reused", F.lit(False))
    return old.unionByName(new)


def with_relevance(results: DataFrame, reranker: Reranker, query_col: str = "query", text_col: str = "text", out: str = "relevance") -> DataFrame:
    @F.pandas_udf("double")
    def score(queries: pd.Series, texts: pd.Series) -> pd.Series:
        found = pd.Series(0.0, index=texts.index)
        for query, at in queries.fillna("").groupby(queries.fillna("")).groups.items():
            found.loc[at] = reranker.score(query, texts.loc[at].fillna("").tolist())
        return found

    return results.withColumn(out, score(F.col(query_col), F.col(text_col)))


def with_answers(prompts: DataFrame, model: LanguageModel, prompt_col: str = "prompt", out: str = "answer") -> DataFrame:
    @F.pandas_udf("string")
    def answer(batch: pd.Series) -> pd.Series:
        return pd.Series(model.answer(batch.fillna("").tolist()), index=batch.index)

    return prompts.withColumn(out, answer(F.col(prompt_col)))


def cascade(*levels: dict[str, Any]) -> dict[str, Any]:
    """Nested settings, later levels first."""
    out: dict[str, Any] = {}
    for level in levels:
        for key, value in level.items():
            out[key] = cascade(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def allowed(action: str, white: Iterable[str] = (), black: Iterable[str] = (), calls: int = 0, most: int | None = None) -> bool:
    """A policy: not black-listed, white-listed if there is such a list, and within its number of calls."""
    white = set(white)
    return action not in set(black) and (not white or action in white) and (most is None or calls < most)
