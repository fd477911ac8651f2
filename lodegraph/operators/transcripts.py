"""Transcripts and dossiers: speakers, steps, headers, paragraphs, citations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Speaker formats in the order in which they are tried; each names the speaker.
SPEAKERS = (
    r"^\[(?P<time>\d{1,2}:\d{2}(?::\d{2})?)\]\s*(?P<speaker>[^:\n]{1,60}):",
    r"^(?P<speaker>[^:\n(]{1,60})\s*\((?P<time>\d{1,2}:\d{2}(?::\d{2})?)\):",
    r"^\*\*(?P<speaker>[^*\n]{1,60})\*\*\s*:",
    r"^(?P<speaker>[A-ZÀ-Ý][\wÀ-ÿ.'-]*(?: [A-ZÀ-Ý][\wÀ-ÿ.'-]*){0,3}):",
)
LEAST_TURNS, MOST_CHARS = 2, 500
NUMBERED = re.compile(r"^\s*(?:\d+[.)]|[Ss]tep \d+[:.])\s+(.+)$", re.M)
CONNECTOR = re.compile(r"\b(?:first|then|next|after that|finally|primeiro|depois|em seguida|por fim)\b[,:]?\s*", re.I)


def segments_of(text: str) -> list[tuple[str, str | None, str]]:
    """(speaker, time, text) of each turn; the first format with two turns at least is the text's."""
    for pattern in SPEAKERS:
        found = list(re.finditer(pattern, text, re.M))
        if len(found) >= LEAST_TURNS:
            ends = [m.start() for m in found[1:]] + [len(text)]
            return [(m["speaker"].strip(), m.groupdict().get("time"), text[m.end() : end].strip()[:MOST_CHARS]) for m, end in zip(found, ends)]
    return []


def speaker_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, *s) for i, t in batch.itertuples(index=False) for n, s in enumerate(segments_of(t or ""))]
            yield pd.DataFrame(rows, columns=[id_col, "pos", "speaker", "time", "segment"])

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, pos int, speaker string, time string, segment string")


def steps_of(text: str) -> list[str]:
    """A numbered list of two steps at least, else what connecting words set apart."""
    numbered = [s.strip() for s in NUMBERED.findall(text)]
    if len(numbered) >= 2:
        return numbered
    parts = [p.strip(" .,;\n") for p in CONNECTOR.split(text)[1:]]
    return [p for p in parts if p] if len([p for p in parts if p]) >= 2 else []


def header(text: Column, name: str) -> Column:
    """Value of a ``Name: value`` line."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^{name}\s*:[ \t]*(.*)$", 1)), F.lit(""))


def body(text: Column) -> Column:
    """What follows the third line of equals signs, else the second, else all."""
    parts = F.split(text, r"(?m)^={10,}\s*$")
    rest = lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "\n")
    found = F.when(F.size(parts) > 3, rest(4)).when(F.size(parts) > 2, rest(3)).otherwise(text)
    return F.regexp_replace(found, r"^\s+|\s+$", "")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, paragraph): blank-line blocks outside code fences that are no heading, table, quote or rule."""
    bare = F.regexp_replace(F.col(text_col), r"(?s)```.*?(```|\z)", "")
    blocks = docs.select(id_col, F.posexplode(F.split(bare, r"\n\s*\n")).alias("pos", "paragraph")).withColumn("paragraph", F.trim("paragraph"))
    return blocks.where((F.col("paragraph") != "") & ~F.col("paragraph").rlike(r"^(#|\||>|---|===|\*\*\*)"))


def citation_share(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = r"\[chunk_") -> DataFrame:
    """Share of statement lines (bullets, numbers, quotes) that cite, and its verdict."""
    bare = F.regexp_replace(F.col(text_col), r"(?s)```.*?(```|\z)", "")
    lines = docs.select(id_col, F.explode(F.split(bare, "\n")).alias("line")).where(F.col("line").rlike(r"^\s*([-*>]|\d+[.)])\s"))
    per = lines.groupBy(id_col).agg(F.count("*").alias("statements"), F.count_if(F.col("line").rlike(mark)).alias("cited"))
    share = F.round(F.col("cited") / F.col("statements"), 3)
    return per.withColumn("share", share).withColumn("verdict", F.when(F.col("share") >= 0.8, "PASS").when(F.col("share") >= 0.5, "WARN").otherwise("FAIL"))


def top_citations(scored: DataFrame, paragraph: str, score: str, k: int = 3) -> DataFrame:
    order = Window.partitionBy(paragraph).orderBy(F.col(score).desc(), "entry")
    return scored.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")
