"""Word documents, read with the standard library: an archive of XML parts.

Blocks come in the order body, headers, footers, footnotes, comments. A paragraph's text is its runs in order, with tabs, breaks and note references;
runs keep their formatting as spans. Styles inherit along basedOn; headings are known by outline level, by the style's, or by its name.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from .blocks import Block, Parsed, under
from .decode import ParseError

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
#: Names of heading styles in several languages, and what stands for no in an on/off property.
HEADING_NAME = re.compile(r"^(?:heading|title|überschrift|titre|título|titolo|kop|rubrik|tiêu đề|đề mục)\s*(\d*)$", re.I)
OFF = {"0", "false", "off", "none"}
STYLES = {"b": "bold", "i": "italic", "u": "underline", "strike": "strike"}


def _on(node: ET.Element | None) -> bool:
    return node is not None and (node.get(W + "val") or "true").lower() not in OFF


def _value(node: ET.Element | None, path: str) -> str | None:
    found = node.find(path) if node is not None else None
    return found.get(W + "val") if found is not None else None


class _Docx:
    def __init__(self, data: bytes, limit: int):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as error:
            raise ParseError("not a Word document") from error
        if sum(x.file_size for x in self.zip.infolist()) > limit:
            raise ParseError("the document unpacks to more than the limit")
        if "word/document.xml" not in self.zip.namelist():
            raise ParseError("the document has no body")
        self.out = Parsed(TYPE)
        self.path: list[str] = []
        styles = self.part("word/styles.xml")
        self.styles = {s.get(W + "styleId"): s for s in styles.iter(W + "style")} if styles is not None else {}
        self.numbers = self.numbering()

    def part(self, name: str) -> ET.Element | None:
        if name not in self.zip.namelist():
            return None
        try:
            return ET.fromstring(self.zip.read(name))
        except ET.ParseError:
            if name == "word/document.xml":
                raise ParseError("the body is not valid XML") from None
            self.out.warn(f"{name} is not valid XML")
            return None

    def relations(self, name: str) -> dict[str, str]:
        folder, base = posixpath.split(name)
        root = self.part(f"{folder}/_rels/{base}.rels")
        if root is None:
            return {}
        return {x.get("Id"): posixpath.normpath(posixpath.join(folder, x.get("Target", ""))).lstrip("/") for x in root if x.get("TargetMode") != "External"}

    def numbering(self) -> dict[tuple[str, int], dict]:
        root = self.part("word/numbering.xml")
        if root is None:
            return {}
        kinds = {x.get(W + "abstractNumId"): x for x in root.findall(W + "abstractNum")}
        out = {}
        for n in root.findall(W + "num"):
            for level in kinds.get(_value(n, W + "abstractNumId"), ET.Element("none")).findall(W + "lvl"):
                out[n.get(W + "numId"), int(level.get(W + "ilvl", "0"))] = {"format": _value(level, W + "numFmt"), "level_text": _value(level, W + "lvlText"), "start": _value(level, W + "start")}
        return out

    def chain(self, style: str | None) -> list[ET.Element]:
        """A style and those it is based on, each once."""
        seen, out = set(), []
        while style in self.styles and style not in seen:
            seen.add(style)
            out.append(self.styles[style])
            style = _value(self.styles[style], W + "basedOn")
        return out

    def level(self, p: ET.Element) -> int | None:
        """Heading level of a paragraph, from 1."""
        own = p.find(W + "pPr")
        chain = self.chain(_value(own, W + "pStyle"))
        for props in [own, *(s.find(W + "pPr") for s in chain)]:
            if (v := _value(props, W + "outlineLvl")) is not None and v.isdigit() and int(v) < 9:
                return int(v) + 1
        for s in chain:
            if m := HEADING_NAME.match((_value(s, W + "name") or "").strip()):
                return int(m[1] or 1)
        return None

    def listed(self, p: ET.Element) -> dict | None:
        own = p.find(W + "pPr")
        for props in [own, *(s.find(W + "pPr") for s in self.chain(_value(own, W + "pStyle")))]:
            num = props.find(W + "numPr") if props is not None else None
            if num is not None:
                number, level = _value(num, W + "numId"), int(_value(num, W + "ilvl") or 0)
                if number is None or number == "0":
                    return None
                return {"num_id": number, "level": level, **self.numbers.get((number, level), {})}
        return None

    def runs(self, p: ET.Element) -> tuple[str, list[dict]]:
        """Text of a paragraph without its text boxes, and formatted spans."""
        out, spans = "", []

        def walk(node: ET.Element) -> None:
            nonlocal out
            for x in node:
                if x.tag == W + "r":
                    text = self.run_text(x)
                    if out and text and _joins(out[-1], text[0]):
                        out += " "
                    props = x.find(W + "rPr")
                    style = [name for tag, name in STYLES.items() if props is not None and _on(props.find(W + tag))]
                    if style and text:
                        spans.append({"start": len(out), "end": len(out) + len(text), "style": style})
                    out += text
                elif x.tag not in (W + "pPr", W + "txbxContent", W + "del"):
                    walk(x)

        walk(p)
        return out, spans

    @staticmethod
    def run_text(r: ET.Element) -> str:
        out = ""
        for x in r:
            name = x.tag.removeprefix(W)
            if name == "t":
                out += x.text or ""
            else:
                out += {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "‑", "softHyphen": "­"}.get(name, "")
                if name in ("footnoteReference", "commentReference"):
                    out += f"[{name.removesuffix('Reference')} {x.get(W + 'id')}]"
        return out

    def container(self, root: ET.Element, part: str, relations: dict[str, str], kind: str | None = None, **more: object) -> None:
        for x in root:
            if x.tag == W + "p":
                self.paragraph(x, part, kind, **more)
            elif x.tag == W + "tbl":
                rows = self.table(x)
                if any(c.strip() for r in rows for c in r):
                    self.put("\n".join(" | ".join(r) for r in rows), kind or "table", part, content_kind="table", rows=rows, **more)
            elif x.tag in (W + "sdt", W + "sdtContent"):
                self.container(x, part, relations, kind, **more)
        for box in root.iter(W + "txbxContent"):
            for p in box.iter(W + "p"):
                self.paragraph(p, part, kind, text_box=True, **more)
        labels = {}
        for drawing in (x for tag in ("inline", "anchor") for x in root.iter(WP + tag)):
            own = next(drawing.iter(WP + "docPr"), None)
            name = next((x for x in (own.get("descr"), own.get("title"), own.get("name")) if x), None) if own is not None else None
            labels.update({id(blip): name for blip in drawing.iter(A + "blip")})
        for blip in root.iter(A + "blip"):
            target = relations.get(blip.get(R + "embed", ""))
            if target and target in self.zip.namelist():
                data = self.zip.read(target)
                sha = hashlib.sha256(data).hexdigest()
                self.out.assets[sha] = data
                name = labels.get(id(blip)) or posixpath.basename(target)
                self.put(f"[Image: {name}]", "image", part, sha256=sha, target=target, **more)

    def paragraph(self, p: ET.Element, part: str, kind: str | None, **more: object) -> None:
        text, spans = self.runs(p)
        if not text.strip():
            return
        level, item = self.level(p), self.listed(p)
        own = "heading" if level else "list_item" if item else "paragraph"
        if level and kind is None:
            self.path = under(self.path, level, text.strip())
        details = ({"level": level} if level else {}) | ({"list": item} if item else {}) | ({"formatting": spans} if spans else {}) | ({"content_kind": own} if kind else {})
        self.put(text.strip(), kind or own, part, **details, **more)

    def table(self, tbl: ET.Element) -> list[list[str]]:
        """Rows of cell texts; a nested table stands in its cell, set in."""
        rows = []
        for tr in tbl.findall(W + "tr"):
            row = []
            for tc in tr.findall(W + "tc"):
                parts = []
                for x in tc:
                    if x.tag == W + "p" and (text := self.runs(x)[0].strip()):
                        parts.append(text)
                    elif x.tag == W + "tbl":
                        parts.append("[Nested table]\n" + "\n".join("  " + " | ".join(r) for r in self.table(x)))
                row.append(" / ".join(parts))
            rows.append(row)
        return rows

    def put(self, text: str, kind: str, part: str, **metadata: object) -> None:
        self.out.blocks.append(Block(text, kind, heading_path=list(self.path) if part == "document" else [], metadata={"part": part, **metadata}))

    def read(self) -> Parsed:
        body = self.part("word/document.xml").find(W + "body")
        self.container(body if body is not None else ET.Element("none"), "document", self.relations("word/document.xml"))
        for kind in ("header", "footer"):
            for name in sorted(n for n in self.zip.namelist() if re.fullmatch(rf"word/{kind}\d*\.xml", n)):
                root = self.part(name)
                if root is not None:
                    self.container(root, kind, self.relations(name), kind)
        for kind in ("footnote", "comment"):
            root = self.part(f"word/{kind}s.xml")
            for note in root.findall(W + kind) if root is not None else []:
                number = note.get(W + "id", "0")
                if kind == "footnote" and int(number) <= 0:
                    continue
                more = {"id": number} | {k: note.get(W + k) for k in ("author", "initials", "date") if kind == "comment" and note.get(W + k)}
                self.container(note, kind, self.relations(f"word/{kind}s.xml"), kind, **more)
        core = self.part("docProps/core.xml")
        if core is not None:
            self.out.metadata["properties"] = {x.tag.rpartition("}")[2]: x.text for x in core if x.text}
        return self.out


def _joins(before: str, after: str) -> bool:
    """Two runs that lost the space between them."""
    return (before.islower() and after.isupper()) or (before in ".,;:!?" and after.isalnum())


def parse_docx(data: bytes, name: str = "", limit: int = 200 * 1024 * 1024) -> Parsed:
    return _Docx(data, limit).read()
