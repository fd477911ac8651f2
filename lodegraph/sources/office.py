"""Files of many kinds to markdown and plain text: dispatch by extension, WordprocessingML by the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators.chunking import page_text

#: Bytes of a file -> (markdown, plain text).
Reader = Callable[[bytes], tuple[str, str]]
#: Largest part of an archive that is unpacked: a small file can hold a huge one.
MOST_BYTES = 256 << 20
UNTAGGED = "_untagged"
OUT = "path string, name string, kind string, source_tag string, markdown string, text string, error string"

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_NOT_XML = re.compile(f"[^\t\n\r -{chr(0xD7FF)}{chr(0xE000)}-{chr(0xFFFD)}{chr(0x10000)}-{chr(0x10FFFF)}]")


def _part(archive: zipfile.ZipFile, name: str) -> bytes | None:
    if name not in archive.namelist():
        return None
    if archive.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"{name} has more than {MOST_BYTES} bytes")
    found = archive.read(name)
    if b"<!DOCTYPE" in found[:4096] or b"<!ENTITY" in found:
        raise ValueError(f"{name} declares entities")
    return found


def _value(node: ElementTree.Element | None, tag: str) -> str | None:
    found = None if node is None else node.find(_W + tag)
    return None if found is None else found.get(_W + "val", "")


class _Word:
    """One document: styles, lists and links are looked up by id, the body is read paragraph by paragraph."""

    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            body, styles, lists, links = (_part(archive, f"word/{n}") for n in ("document.xml", "styles.xml", "numbering.xml", "_rels/document.xml.rels"))
        if body is None:
            raise ValueError("no word/document.xml")
        self.body = ElementTree.fromstring(body).find(f"{_W}body")
        self.levels = self._headings(styles)
        self.links = {} if links is None else {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(links)}
        self.bullets = self._lists(lists)

    @staticmethod
    def _headings(styles: bytes | None) -> dict[str, int]:
        found = {}
        for style in () if styles is None else ElementTree.fromstring(styles).iter(f"{_W}style"):
            named = re.fullmatch(r"heading ([1-6])", (_value(style, "name") or "").lower())
            outline = _value(style.find(f"{_W}pPr"), "outlineLvl")
            if named:
                found[style.get(f"{_W}styleId")] = int(named[1])
            elif outline is not None and outline.isdigit() and int(outline) < 6:
                found[style.get(f"{_W}styleId")] = int(outline) + 1
        return found

    @staticmethod
    def _lists(lists: bytes | None) -> dict[tuple[str, str], bool]:
        """(list id, level) -> whether its items have bullets."""
        if lists is None:
            return {}
        root = ElementTree.fromstring(lists)
        kinds = {a.get(f"{_W}abstractNumId"): {v.get(f"{_W}ilvl"): _value(v, "numFmt") == "bullet" for v in a.iter(f"{_W}lvl")} for a in root.iter(f"{_W}abstractNum")}
        return {(n.get(f"{_W}numId"), level): kind for n in root.iter(f"{_W}num") for level, kind in kinds.get(_value(n, "abstractNumId"), {}).items()}

    def blocks(self, node: ElementTree.Element) -> Iterator[ElementTree.Element]:
        """Paragraphs and tables in order, through content controls and tracked insertions."""
        for child in node:
            if child.tag in (f"{_W}p", f"{_W}tbl"):
                yield child
            elif child.tag in (f"{_W}sdt", f"{_W}sdtContent", f"{_W}ins", f"{_W}customXml"):
                yield from self.blocks(child)

    def spans(self, node: ElementTree.Element, link: str | None = None) -> Iterator[tuple[str, bool, bool, str | None]]:
        """(text, bold, italic, link) of the runs; what was deleted is left out."""
        for child in node:
            if child.tag == f"{_W}r":
                how = child.find(f"{_W}rPr")
                on = [(_value(how, t) or "1") not in ("0", "false", "none", "off") if how is not None and how.find(_W + t) is not None else False for t in ("b", "i")]
                parts = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}
                text = "".join((c.text or "") if c.tag == f"{_W}t" else parts.get(c.tag, "") for c in child)
                if text:
                    yield (text, *on, link)
            elif child.tag == f"{_W}hyperlink":
                yield from self.spans(child, self.links.get(child.get(f"{_R}id")))
            elif child.tag in (f"{_W}ins", f"{_W}smartTag", f"{_W}sdt", f"{_W}sdtContent", f"{_W}fldSimple"):
                yield from self.spans(child, link)

    def plain(self, node: ElementTree.Element) -> str:
        return "".join(s[0] for s in self.spans(node))

    def inline(self, node: ElementTree.Element) -> str:
        """Markdown of the runs, those of one format next to each other as one."""
        merged: list[list] = []
        for text, *how in self.spans(node):
            if merged and merged[-1][1] == how:
                merged[-1][0] += text
            else:
                merged.append([text, how])
        out = []
        for text, (bold, italic, link) in merged:
            inner = text.strip()
            if inner:
                mark = "**" * bold + "*" * italic
                made = f"{mark}{inner}{mark[::-1]}"
                made = f"[{made}]({link})" if link else made
                text = text[: len(text) - len(text.lstrip())] + made + text[len(text.rstrip()) :]
            out.append(text)
        return re.sub(r"[ \t]+", " ", "".join(out)).strip()

    def paragraph(self, node: ElementTree.Element, counts: dict) -> str:
        how, text = node.find(f"{_W}pPr"), self.inline(node)
        level = self.levels.get(_value(how, "pStyle") or "")
        if level and text:
            return "#" * level + " " + text
        listed = None if how is None else how.find(f"{_W}numPr")
        if listed is None or _value(listed, "numId") in (None, "0") or not text:
            return text
        number, depth = _value(listed, "numId"), _value(listed, "ilvl") or "0"
        for key in [k for k in counts if k[0] == number and int(k[1]) > int(depth)]:
            del counts[key]
        counts[number, depth] = counts.get((number, depth), 0) + 1
        bullet = self.bullets.get((number, depth), True)
        return "   " * int(depth) + ("- " if bullet else f"{counts[number, depth]}. ") + text.replace("\n", " ")

    def table(self, node: ElementTree.Element) -> str:
        """A pipe table: the first row is its head, cells that go on from the row above are empty, tables within cells are text."""
        rows = []
        for row in node.iter(f"{_W}tr") if node.find(f"{_W}tr") is None else node.findall(f"{_W}tr"):
            cells = []
            for cell in row.findall(f"{_W}tc"):
                how = cell.find(f"{_W}tcPr")
                merged = None if how is None else how.find(f"{_W}vMerge")
                texts = [] if merged is not None and merged.get(f"{_W}val", "continue") == "continue" else [self.inline(p) for p in cell.iter(f"{_W}p")]
                cells.append(" ".join(" ".join(texts).split()).replace("|", r"\|"))
                span = _value(how, "gridSpan") or "1"
                cells += [""] * (int(span) - 1 if span.isdigit() else 0)
            rows.append(cells)
        width = max((len(r) for r in rows), default=0)
        if not width:
            return ""
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])

    def markdown(self) -> str:
        out, counts, listing = "", {}, False
        for block in self.blocks(self.body):
            made = self.table(block) if block.tag == f"{_W}tbl" else self.paragraph(block, counts)
            if not made.strip():
                continue
            item = block.tag == f"{_W}p" and bool(re.match(r" *(- |\d+\. )", made)) and block.find(f"{_W}pPr/{_W}numPr") is not None
            out += ("" if not out else "\n" if item and listing else "\n\n") + made
            listing = item
        return out

    def text(self) -> str:
        return "\n\n".join(self.plain(p) for p in self.body.iter(f"{_W}p"))


def docx(content: bytes) -> tuple[str, str]:
    """Markdown and plain text (paragraphs apart by an empty line) of a .docx; comments, notes, headers and pictures are left out."""
    found = _Word(content)
    return found.markdown(), found.text()


def html(content: bytes) -> tuple[str, str]:
    text = page_text(content.decode("utf-8", "replace"))
    return text, text


def plain(content: bytes) -> tuple[str, str]:
    text = content.decode("utf-8-sig")
    return text, text


#: Extension -> reader; more are given to ``extracted``, such as one for .pdf where a library for it is there.
READERS: dict[str, Reader] = {".docx": docx, ".html": html, ".htm": html, ".md": plain, ".txt": plain}


def source_tag(path: str) -> str:
    """The nearest of the two folders above a file that is no inbox and not hidden."""
    above = path.replace("\\", "/").split("/")[:-1]
    return next((n for n in above[:-3:-1] if n and not n.startswith((".", "_", "inbox"))), UNTAGGED)


def extracted(files: DataFrame, readers: dict[str, Reader] | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """(path, name, kind, source_tag, markdown, text, error) of files (path, content), each read by what its extension asks for.

    The markdown begins with the file's name as a title. A file that cannot be read, of an unknown kind, or null is a row with an
    error and no text, and fails no job; an empty text file is an empty text. Rows are read one by one, in batches of bounded bytes.
    """
    known = READERS | (readers or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, held in zip(batch.column(0), batch.column(1)):
                where = at.as_py() or ""
                name = where.rsplit("/", 1)[-1]
                stem, dot, end = name.rpartition(".")
                kind, body, text, error = (f".{end.lower()}" if dot else ""), None, None, None
                if kind not in known:
                    error = f"no reader for {kind or 'files without an extension'}"
                elif not held.is_valid:
                    error = "no content"
                else:
                    try:
                        body, text = known[kind](held.as_py())
                        body = f"# {stem}\n\n*Source: {name}*\n\n---\n\n{body}"
                    except Exception as problem:  # noqa: BLE001  whatever a broken file makes a reader raise is the file's error
                        error = f"{type(problem).__name__}: {problem}"
                row = (at.as_py(), name, kind, source_tag(where), body, text, error)
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in row], names=["path", "name", "kind", "source_tag", "markdown", "text", "error"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, OUT)


def read_files(spark: SparkSession, folder: str, readers: dict[str, Reader] | None = None) -> DataFrame:
    """All files below a folder, ``extracted``; Spark lists no file of zero bytes, so there is no row of it."""
    return extracted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder), readers)


def docx_bytes(text: str | None) -> bytes:
    """A .docx whose paragraphs are the lines of a text; characters that XML cannot hold are left out, null is one empty paragraph."""
    escape = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", "\r": "&#13;"})
    runs = (f'<w:p><w:r><w:t xml:space="preserve">{line.translate(escape)}</w:t></w:r></w:p>' for line in _NOT_XML.sub("", text or "").split("\n"))
    body = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{"".join(runs)}</w:body></w:document>'
    kinds = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    start = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, part in (("[Content_Types].xml", kinds), ("_rels/.rels", start), ("word/document.xml", body)):
            archive.writestr(zipfile.ZipInfo(name), part.encode(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def as_docx(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, content) of texts as .docx files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, held in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array([at.as_py()], pa.string()), pa.array([docx_bytes(held.as_py())], pa.binary())], names=["path", "content"])

    return texts.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(run, "path string, content binary")
