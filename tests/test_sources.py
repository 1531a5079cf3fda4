import io
import zipfile
import zlib

import pytest

from tarnflow.sources import files
from tarnflow.sources.decode import ParseError, decode
from tarnflow.sources.docx import parse_docx
from tarnflow.sources.markdown import fragment_text, inline, parse_markdown
from tarnflow.sources.pdf import parse_pdf
from tarnflow.sources.text import parse_text

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def p(text, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_decoding_ladder():
    assert decode("é".encode()).encoding == "utf-8"
    assert decode("é".encode("utf-8-sig")).text == "é"
    assert decode("abc".encode("utf-16")).text == "abc"
    assert decode("abc".encode("utf-32")).text == "abc"
    assert decode("hello there, é".encode("utf-16-le")).text == "hello there, é"
    old = decode(b"\xe9\xe8 \x93x\x94")
    assert old.warnings and "�" not in old.text


def test_paragraphs_know_their_places():
    text = "one\ntwo\n \t\n  three  \n\n\n"
    blocks = parse_text(text.encode()).blocks
    assert [b.text for b in blocks] == ["one\ntwo", "three"]
    for b in blocks:
        s = b.metadata["source"]
        assert text[s["start_char"] : s["end_char"]] == b.text
    assert blocks[1].metadata["source"]["start_line"] == 4


def test_markdown_blocks_and_headings():
    out = parse_markdown(b"# A\n\ntext\n\n## B\n\n- [ ] todo\n\n### C\n\n# D\n\n```\ncode")
    assert [(b.kind, b.heading_path) for b in out.blocks] == [("heading", ["A"]), ("paragraph", ["A"]), ("heading", ["A", "B"]), ("list_item", ["A", "B"]), ("heading", ["A", "B", "C"]), ("heading", ["D"]), ("code", ["D"])]
    assert out.blocks[3].metadata["checked"] is False
    assert any("Unclosed" in w for w in out.warnings)


def test_markdown_inline_spans():
    text, marks = inline("a **b *c*** `d` [e](f) ![g](h) ~~i~~", {})
    assert text == "a b c d e g i"
    assert {(s["style"], text[s["start"] : s["end"]]) for s in marks["formatting"]} == {("bold", "b c"), ("italic", "c"), ("inline_code", "d"), ("strike", "i")}
    assert marks["links"][0]["href"] == "f" and marks["images"][0]["src"] == "h"


def test_markdown_table_and_warning():
    table = parse_markdown(b"| a | b |\n|:--|--:|\n| 1 | 2 |").blocks[0]
    assert table.text == "a | b\n1 | 2" and table.metadata["rows"][1][1] == {"text": "2", "header": False, "align": "right"}
    assert any("table" in w for w in parse_markdown(b"| a | b |\n|---|\n").warnings)


def test_html_fragment():
    assert fragment_text("<div>a<br>b</div><script>x</script><p> c </p>") == "a\nb\nc"


def test_docx_structure():
    styles = f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style><w:style w:styleId="K"><w:basedOn w:val="H"/></w:style></w:styles>'
    table = "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + p("c") + "</w:tc></w:tr></w:tbl>"
    notes = f'<w:footnotes {W}><w:footnote w:id="0">{p("no")}</w:footnote><w:footnote w:id="2">{p("note")}</w:footnote></w:footnotes>'
    item = '<w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr>'
    data = docx(p("Title", '<w:outlineLvl w:val="0"/>') + p("Sub", '<w:pStyle w:val="K"/>') + p("x", item) + table, word__styles_xml=styles, word__footnotes_xml=notes)
    out = parse_docx(data)
    assert [(b.kind, b.text) for b in out.blocks] == [("heading", "Title"), ("heading", "Sub"), ("list_item", "x"), ("table", "a | b / c"), ("footnote", "note")]
    assert out.blocks[2].heading_path == ["Title", "Sub"]


def test_docx_guards():
    with pytest.raises(ParseError):
        parse_docx(b"no zip")
    with pytest.raises(ParseError):
        parse_docx(docx(p("x" * 1000)), limit=10)


def pdf(content, flate=False):
    raw = zlib.compress(content) if flate else content
    filter_ = b"/Filter/FlateDecode" if flate else b""
    return b"%%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Kids[3 0 R]/MediaBox[0 0 612 792]>>endobj\n3 0 obj<</Type/Page/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>endobj\n4 0 obj<</Length %d%s>>stream\n%s\nendstream endobj\n5 0 obj<</Type/Font>>endobj\n" % (len(raw), filter_, raw)


@pytest.mark.parametrize("flate", [False, True])
def test_pdf_headings_lists_and_lines(flate):
    out = parse_pdf(pdf(b"BT /F1 22 Tf 72 700 Td (Head \\(x\\)) Tj ET BT /F1 10 Tf 12 TL 72 650 Td (A long line of body text to set the si-) Tj T* (ze of it all.) Tj 0 -40 Td (1. item) Tj ET", flate))
    assert [(b.kind, b.text) for b in out.blocks] == [("heading", "Head (x)"), ("paragraph", "A long line of body text to set the size of it all."), ("list_item", "1. item")]


def test_pdf_empty_page_and_bad_file():
    assert parse_pdf(pdf(b"")).warnings == ["Page 1 is empty"]
    with pytest.raises(ParseError):
        parse_pdf(b"hello")


def test_registry():
    r = files.default_registry()
    assert r.extensions() == [".docx", ".markdown", ".md", ".pdf", ".txt"]
    with pytest.raises(ParseError, match="supported"):
        r.parser_for("/a/b.xyz")
    r.register([".TXT"], parse_markdown, "x")
    assert r.parser_for("/a/b.txt") is parse_markdown
