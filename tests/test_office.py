"""Files to text: dispatch, headings, lists within lists, tables, broken and hostile files."""

from __future__ import annotations

import io
import zipfile

from lodegraph.sources import office
from lodegraph.session import importable

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def made(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        for name, text in parts.items():
            archive.writestr({"styles": "word/styles.xml", "numbering": "word/numbering.xml", "links": "word/_rels/document.xml.rels"}[name], text)
    return out.getvalue()


def p(text, props="", run=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t xml:space='preserve'>{text}</w:t></w:r></w:p>"


def item(text, level, number=1):
    return p(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr>')


STYLES = f'<w:styles {NS}><w:style w:styleId="T1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Own"><w:name w:val="Part"/><w:pPr><w:outlineLvl w:val="2"/></w:pPr></w:style></w:styles>'
LISTS = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>'
LINKS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r5" Target="https://example.org/a"/></Relationships>'


def cell(text, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{p(text)}</w:tc>"


def test_headings_runs_and_links():
    body = p("Prices", '<w:pStyle w:val="T1"/>') + p("Later", '<w:pStyle w:val="Own"/>')
    body += "<w:p><w:r><w:t xml:space='preserve'>We </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t xml:space='preserve'>raise </w:t></w:r><w:r><w:rPr><w:b w:val='1'/></w:rPr><w:t>them</w:t></w:r><w:r><w:rPr><w:b w:val='0'/><w:i/></w:rPr><w:t xml:space='preserve'> now</w:t></w:r>"
    body += "<w:del><w:r><w:delText>never</w:delText></w:r></w:del><w:ins><w:r><w:t xml:space='preserve'> and </w:t></w:r></w:ins><w:hyperlink r:id='r5'><w:r><w:t>here</w:t></w:r></w:hyperlink><w:r><w:br/><w:t>next &amp; last</w:t></w:r></w:p>"
    markdown, text = office.docx(made(body, styles=STYLES, links=LINKS))
    assert markdown == "# Prices\n\n### Later\n\nWe **raise them** *now* and [here](https://example.org/a)\nnext & last"
    assert text == "Prices\n\nLater\n\nWe raise them now and here\nnext & last"


def test_lists_within_lists():
    body = item("one", 0) + item("a", 1) + item("b", 1) + item("two", 0) + item("c", 1) + p("end")
    assert office.docx(made(body, numbering=LISTS))[0] == "- one\n   1. a\n   2. b\n- two\n   1. c\n\nend"


def test_tables():
    rows = f"<w:tr>{cell('name')}{cell('a|b')}{cell('n')}</w:tr><w:tr>{cell('x', '<w:vMerge w:val=%srestart%s/>' % (chr(34), chr(34)))}{cell('wide', '<w:gridSpan w:val=%s2%s/>' % (chr(34), chr(34)))}</w:tr><w:tr>{cell('hidden', '<w:vMerge/>')}{cell('1')}</w:tr>"
    inner = f"<w:tbl><w:tr><w:tc>{p('deep')}<w:tbl><w:tr>{cell('in')}</w:tr></w:tbl></w:tc></w:tr></w:tbl>"
    markdown, _ = office.docx(made(f"<w:tbl>{rows}</w:tbl><w:sdt><w:sdtContent>{inner}</w:sdtContent></w:sdt>"))
    assert markdown == "| name | a\\|b | n |\n| --- | --- | --- |\n| x | wide |  |\n|  | 1 |  |\n\n| deep in |\n| --- |"


def test_files_of_all_kinds(spark, tmp_path, monkeypatch):
    importable(spark)
    whole = office.docx_bytes("a < b & c\n\n  two  \x01\r")
    held = {
        "inbox/ann/call.DOCX": whole, "inbox/ann/cut.docx": whole[:40], "inbox/bare.docx": made(""), "inbox/none.docx": _zip("other.xml", "x"),
        "inbox/entity.docx": _zip("word/document.xml", '<!DOCTYPE d [<!ENTITY a "b">]><d>&a;</d>'), "inbox/bob/deep/notes.md": "\ufeffhé".encode(), "inbox/bad.txt": b"\xff\xfe\xfa",
        "inbox/empty.txt": b"\xef\xbb\xbf", "inbox/page.html": b"<p>x<br>y</p><script>z</script>", "inbox/scan.pdf": b"%PDF", "inbox/README": b"r", "inbox/own.abc": b"abc",
    }
    for name, content in held.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)
    rows = {r.name: r for r in office.read_files(spark, str(tmp_path / "inbox"), {".abc": lambda b: (b.decode().upper(), b.decode())}).collect()}
    assert len(rows) == len(held)
    call = rows["call.DOCX"]
    assert (call.kind, call.source_tag, call.error, call.text) == (".docx", "ann", None, "a < b & c\n\n\n\n  two  \r") and call.markdown.startswith("# call\n\n*Source: call.DOCX*\n\n---\n\na < b & c\n\ntwo")
    assert {n for n, r in rows.items() if r.error} == {"cut.docx", "none.docx", "entity.docx", "bad.txt", "scan.pdf", "README"} and rows["scan.pdf"].error == "no reader for .pdf"
    assert all(r.text is None and r.markdown is None for r in rows.values() if r.error)
    assert rows["notes.md"].text == "hé" and rows["notes.md"].source_tag == "deep" and rows["empty.txt"].text == "" and rows["bare.docx"].text == "" and rows["own.abc"].markdown.endswith("ABC")
    assert "z" not in rows["page.html"].text
    assert office.source_tag("file:/inbox/_x/a.md") == office.UNTAGGED
    nulls = spark.createDataFrame([("a.docx", None, 1), (None, b"x", 2), ("void.txt", b"", 3)], "path string, content binary, error int")
    assert {r.path: r.error for r in office.extracted(nulls).collect()} == {"a.docx": "no content", None: "no reader for files without an extension", "void.txt": None}
    assert office.extracted(nulls.limit(0)).count() == 0


def test_parts_too_large(monkeypatch):
    monkeypatch.setattr(office, "MOST_BYTES", 10)
    try:
        office.docx(office.docx_bytes("text"))
    except ValueError as error:
        assert "more than 10 bytes" in str(error)
    else:
        raise AssertionError


def _zip(name, text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr(name, text)
    return out.getvalue()
