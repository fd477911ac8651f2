"""Splitting texts: sections, recursive chunks, HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import text as T

MAX_CHARS, OVERLAP, MIN_CHARS = 1500, 150, 100
#: Delimiters from the coarsest to the finest.
DELIMITERS = ("\n\n", "\n", ". ", ", ", " ")


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marker: str = "## ") -> DataFrame:
    """(id, section, start_char, name, content): a section begins at a line that starts with the marker.

    Works within the row: a section is the text between two markers, and its start the length of what is before it.
    """
    pieces = F.split(F.concat(F.lit("\n"), F.col(text_col)), f"\n(?={marker})")
    whole = docs.select(F.col(id_col), pieces.alias("p"), F.startswith(F.col(text_col), F.lit(marker)).alias("led"))
    # The text before the first marker keeps the line break that was put in front of it.
    first = F.when(F.col("led"), F.lit(None)).otherwise(F.substring(F.get("p", F.lit(0)), 2, 1 << 30))
    parts = F.concat(F.array(first), F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))))
    lengths = F.transform(parts, lambda x: F.when(x.isNull(), 0).otherwise(F.length(x) + 1))
    rows = whole.select(id_col, F.posexplode(F.arrays_zip(parts.alias("content"), F.transform(lengths, lambda _, i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, b: a + b)).alias("at"))).alias("section", "s"))
    name = F.when(F.col("section") > 0, F.trim(F.regexp_extract("s.content", f"^{marker}([^\n]*)", 1))).otherwise("")
    return rows.where(F.col("s.content").isNotNull()).select(id_col, "section", F.col("s.at").cast("long").alias("start_char"), name.alias("name"), F.col("s.content").alias("content"))


def split_text(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP, least: int = MIN_CHARS, delimiters: tuple[str, ...] = DELIMITERS) -> list[str]:
    """Pieces of at most ``most`` characters, merged greedily at the coarsest delimiter that occurs; texts too short give none.

    Each piece but the first is led by the last ``overlap`` characters of the one before.
    """
    if len(text) <= most:
        return [text] if len(text) >= least else []
    found = next((i for i, d in enumerate(delimiters) if d in text), None)
    if found is None:
        step = most - overlap if overlap else most
        return [piece for at in range(0, len(text), step) if len(piece := text[at : at + most]) >= least]
    delimiter, finer = delimiters[found], delimiters[found + 1 :]
    pieces: list[str] = []
    held = ""
    for part in text.split(delimiter):
        joined = f"{held}{delimiter}{part}" if held else part
        if len(joined) <= most:
            held = joined
            continue
        if held:
            pieces.append(held)
        held = ""
        if len(part) > most:
            pieces += split_text(part, most, 0, least, finer)
        else:
            held = part
    if held:
        if len(held) < least and pieces and len(pieces[-1]) + len(delimiter) + len(held) <= most:
            pieces[-1] += delimiter + held
        else:
            pieces.append(held)
    return [p if i == 0 or not overlap else pieces[i - 1][-overlap:] + p for i, p in enumerate(pieces)]


def recursive_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MAX_CHARS, overlap: int = OVERLAP, least: int = MIN_CHARS) -> DataFrame:
    """(id, pos, start_char, content, char_count, chunk_id), split document by document in Arrow batches."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sources, pos, starts, contents = [], [], [], [], []
            for doc_id, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                at = 0
                for i, piece in enumerate(split_text(text or "", most, overlap, least)):
                    ids.append(doc_id)
                    sources.append(source)
                    pos.append(i)
                    starts.append(at)
                    contents.append(piece)
                    at += len(piece)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(sources, pa.string()), pa.array(pos, pa.int32()), pa.array(starts, pa.int64()), pa.array(contents, pa.string())], names=[id_col, "source", "pos", "start_char", "content"])

    rows = docs.select(id_col, F.col(source_col).cast("string"), text_col).mapInArrow(run, f"{id_col} {kind}, source string, pos int, start_char long, content string")
    return rows.withColumns({"char_count": F.length("content"), "chunk_id": T.chunk_id(F.col("source"), F.col("start_char"), F.col("content"))})


class _Text(HTMLParser):
    HIDDEN = frozenset(("script", "style", "noscript", "template"))
    BLOCKS = frozenset(("p", "div", "li", "ul", "ol", "br", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "nav", "header", "footer", "title"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.cells = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BLOCKS:
            self.out.append("\n")
            self.cells = 0
        elif tag in ("td", "th"):
            self.out.append(" | " if self.cells else "")
            self.cells += 1

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def page_text(html: str | None) -> str:
    """Visible text, a block a line, table rows with their cells set apart by pipes."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    lines = (" ".join(unescape(line).split()) for line in "".join(parser.out).split("\n"))
    return "\n".join(line for line in lines if line)


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([page_text(h) for h in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[id_col, "text"])

    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, text string")
