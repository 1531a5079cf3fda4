"""PDF files with the standard library: objects, Flate streams, page content, text by position, simple layout.

Reads unencrypted files whose fonts map bytes to text by ToUnicode or are close to Latin-1. What it cannot read it says in a warning: encryption,
other filters, pages that are images only. Pages go in order; on a page rows of text are put together to blocks, two columns are read one
after the other, headings are known by their size against the document's usual one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

from .blocks import Block, Parsed, under
from .decode import ParseError

TOKEN = re.compile(
    rb"\s*(?:%[^\r\n]*[\r\n]\s*)*(?P<t><<|>>|\[|\]|/[^\s<>\[\](){}/%]*|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\d+\s+\d+\s+R(?![A-Za-z])|[+-]?(?:\d+\.?\d*|\.\d+)|[^\s<>\[\](){}/%]+)", re.S
)
OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: List marks, numbered formulas, section headings, operators that draw, and measures in points.
LIST_MARK = re.compile(r"^\s*(?P<mark>[-•●▪◦‣*]|\d{1,3}[.)]|[a-zA-Z][.)])\s+")
FORMULA = re.compile(r"^(?=.*[=≤≥≈∑∫√±×÷])[^.!?]{3,}\(\d+(?:\.\d+)*\)\s*$")
DRAWING = frozenset((b"m", b"l", b"re", b"c", b"v", b"y", b"S", b"s"))
ROW_GAP, MARGIN, DRAWINGS = 3.0, 0.015, 12


@dataclass
class Fragment:
    x: float
    y: float
    size: float
    text: str
    width: float


class Ref(int):
    """The number of an object."""


class _Pdf:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ParseError("not a PDF file")
        self.data = data
        self.at = {int(m[1]): m.end() for m in OBJECT.finditer(data)}
        self.packed: dict[int, object] = {}
        self.encrypted = b"/Encrypt" in data
        if not self.encrypted:
            for n in list(self.at):
                value, stream = self.object(n)
                if isinstance(value, dict) and value.get("Type") == "ObjStm" and stream is not None:
                    self.unpack(value, stream)

    def value(self, data: bytes, pos: int) -> tuple[object, int]:
        m = TOKEN.match(data, pos)
        if not m:
            return None, len(data)
        t, pos = m["t"], m.end()
        if t == b"<<":
            out: dict = {}
            while True:
                key, pos = self.value(data, pos)
                if key is None or key == ">>":
                    return out, pos
                item, pos = self.value(data, pos)
                out[str(key)] = item
        if t == b"[":
            items = []
            while True:
                item, pos = self.value(data, pos)
                if item is None or item == "]":
                    return items, pos
                items.append(item)
        if t[:1] == b"/":
            return re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), t[1:]).decode("latin-1"), pos
        if t[:1] == b"(":
            return _literal(t[1:-1]), pos
        if t[:1] == b"<" and t != b"<<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), pos
        if t.endswith(b"R") and t[:1].isdigit():
            return Ref(t.split()[0]), pos
        if re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", t):
            return float(t) if b"." in t else int(t), pos
        return t.decode("latin-1"), pos

    def object(self, n: int) -> tuple[object, bytes | None]:
        if n not in self.at:
            return self.packed.get(n), None
        value, pos = self.value(self.data, self.at[n])
        m = re.compile(rb"\s*stream\r?\n").match(self.data, pos)
        if not m or not isinstance(value, dict):
            return value, None
        size = self.get(value.get("Length"))
        end = m.end() + size if isinstance(size, int) and self.data[m.end() + size :].lstrip()[:9] == b"endstream" else self.data.find(b"endstream", m.end())
        return value, self.data[m.end() : end]

    def unpack(self, head: dict, stream: bytes) -> None:
        data = self.decoded(head, stream)
        if data is None:
            return
        numbers = [int(x) for x in data[: int(head.get("First", 0))].split()]
        for n, at in zip(numbers[::2], numbers[1::2], strict=False):
            self.packed[n] = self.value(data, int(head["First"]) + at)[0]

    def get(self, value: object) -> object:
        return self.object(int(value))[0] if isinstance(value, Ref) else value

    def stream(self, value: object) -> bytes | None:
        head, raw = self.object(int(value)) if isinstance(value, Ref) else (None, None)
        return self.decoded(head, raw) if raw is not None else None

    def decoded(self, head: dict, raw: bytes) -> bytes | None:
        names = self.get(head.get("Filter")) or []
        for name in names if isinstance(names, list) else [names]:
            if name not in ("FlateDecode", "Fl"):
                return None
            inflate = zlib.decompressobj()
            try:
                raw = inflate.decompress(raw)
            except zlib.error:
                return None
        return raw

    def pages(self) -> list[dict]:
        root = next((v for n in [*self.at, *self.packed] if isinstance(v := self.object(n)[0], dict) and v.get("Type") == "Catalog"), None)
        out: list[dict] = []
        seen: set[int] = set()

        def walk(ref: object, inherited: dict) -> None:
            if isinstance(ref, Ref):
                if int(ref) in seen:
                    return
                seen.add(int(ref))
            node = self.get(ref)
            if not isinstance(node, dict):
                return
            own = inherited | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, own)
            else:
                out.append(own | node)

        if root:
            walk(root.get("Pages"), {})
        return out


def _literal(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else ESCAPES.get(x, b"" if x in (b"\n", b"\r") else x)

    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw, flags=re.S)


def _unicode_map(data: bytes | None) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", data or b"", re.S):
        out |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", data or b"", re.S):
        for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            first = text(b)
            for k in range(int(a, 16), min(int(z, 16), int(a, 16) + 65535) + 1):
                out[k.to_bytes(len(a) // 2, "big")] = first[:-1] + chr(ord(first[-1]) + k - int(a, 16))
    return out


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def fragments(pdf: _Pdf, content: bytes, fonts: dict[str, dict]) -> tuple[list[Fragment], int]:
    """Pieces of text that a page's operators show, and how many operators draw."""
    same = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    now, line, base = same, same, same
    saved: list[tuple] = []
    size, leading, font, drawn = 12.0, 0.0, "", 0
    out: list[Fragment] = []
    args: list = []

    def show(raw: bytes) -> None:
        nonlocal now
        table = fonts.get(font, {})
        if table:
            wide = len(next(iter(table)))
            text = "".join(table.get(raw[k : k + wide], "") for k in range(0, len(raw), wide))
        else:
            text = raw.decode("cp1252", "replace")
        m = _times(now, base)
        scale = size * (abs(m[3]) or abs(m[1]) or 1)
        width = 0.5 * scale * len(text)
        if text:
            out.append(Fragment(m[4], m[5], scale, text, width))
        now = _times((1, 0, 0, 1, 0.5 * size * len(text), 0), now)

    pos = 0
    while pos < len(content):
        m = TOKEN.match(content, pos)
        if not m:
            break
        t = m["t"]
        if t[:1] in b"/([<+-.0123456789":
            value, pos = pdf.value(content, pos)
            args.append(value)
            continue
        pos = m.end()
        n = [float(x) for x in args if isinstance(x, (int, float))]
        if t == b"q":
            saved.append((base, size, leading, font))
        elif t == b"Q" and saved:
            base, size, leading, font = saved.pop()
        elif t == b"cm" and len(n) == 6:
            base = _times(tuple(n), base)
        elif t == b"BT":
            now = line = same
        elif t == b"Tf" and n:
            font, size = str(args[0]), n[-1]
        elif t == b"TL" and n:
            leading = n[-1]
        elif t == b"Tm" and len(n) == 6:
            now = line = tuple(n)
        elif t in (b"Td", b"TD") and len(n) == 2:
            leading = -n[1] if t == b"TD" else leading
            now = line = _times((1, 0, 0, 1, *n), line)
        elif t in (b"T*", b"'", b'"'):
            now = line = _times((1, 0, 0, 1, 0, -leading), line)
        if t in (b"Tj", b"'", b'"') and args and isinstance(args[-1], bytes):
            show(args[-1])
        elif t == b"TJ" and args and isinstance(args[-1], list):
            for x in args[-1]:
                if isinstance(x, bytes):
                    show(x)
                elif isinstance(x, (int, float)):
                    if x < -200 and out and not out[-1].text.endswith(" "):
                        out[-1].text += " "
                    now = _times((1, 0, 0, 1, -x / 1000 * size, 0), now)
        drawn += t in DRAWING
        args = []
    return out, drawn


def rows_of(parts: list[Fragment], width: float) -> list[dict]:
    """Rows of text, cut where a gap is wide; each with its place, size and column group."""
    rows: list[list[Fragment]] = []
    for f in sorted(parts, key=lambda f: (-f.y, f.x)):
        if rows and abs(rows[-1][0].y - f.y) <= ROW_GAP:
            rows[-1].append(f)
        else:
            rows.append([f])
    out: list[dict] = []
    for row in rows:
        row.sort(key=lambda f: f.x)
        at: list[list[Fragment]] = [[row[0]]]
        for a, b in zip(row, row[1:], strict=False):
            if b.x - a.x - a.width > max(36.0, 0.08 * width):
                at.append([])
            at[-1].append(b)
        for seg in at:
            text = ""
            for a, b in zip([None, *seg], seg, strict=False):
                text += (" " if a is not None and b.x - a.x - a.width > 0.15 * b.size and not text.endswith(" ") else "") + b.text
            if text.strip():
                out.append({"text": " ".join(text.split()), "x": seg[0].x, "y": row[0].y, "end": seg[-1].x + seg[-1].width, "size": round(max(f.size for f in seg), 1), "split": len(at) > 1})
    left = [r for r in out if r["split"] and r["x"] < width / 2]
    right = [r for r in out if r["split"] and r["x"] >= width / 2]
    if len(left) >= 2 and len(right) >= 2:
        out.sort(key=lambda r: (r["x"] >= width * 0.45, -r["y"]))
    return out


def parse_pdf(data: bytes, name: str = "", max_pages: int = 2000) -> Parsed:
    out = Parsed("application/pdf")
    pdf = _Pdf(data)
    if pdf.encrypted:
        raise ParseError("the PDF is encrypted")
    pages = pdf.pages()
    if len(pages) > max_pages:
        raise ParseError(f"the PDF has more than {max_pages} pages")
    every: list[tuple[int, float, float, list[dict]]] = []
    for number, page in enumerate(pages, 1):
        box = [float(x) for x in pdf.get(page.get("MediaBox")) or [0, 0, 612, 792]]
        width, height = box[2] - box[0], box[3] - box[1]
        resources = pdf.get(page.get("Resources")) or {}
        fonts = {k: _unicode_map(pdf.stream(f.get("ToUnicode")) if isinstance(f := pdf.get(v), dict) else None) for k, v in (pdf.get(resources.get("Font")) or {}).items()}
        contents = page.get("Contents")
        parts = pdf.get(contents) if isinstance(pdf.get(contents), list) else [contents]
        streams = [pdf.stream(x) for x in parts if x is not None]
        if any(s is None for s in streams):
            out.warn(f"Page {number} has content in a filter that is not read")
        found, drawn = fragments(pdf, b"\n".join(s for s in streams if s), fonts)
        images = [x for x in (pdf.get(resources.get("XObject")) or {}).values() if isinstance(h := pdf.get(x), dict) and h.get("Subtype") == "Image"]
        for x in images:
            head, raw = pdf.object(int(x))
            sha = hashlib.sha256(raw or b"").hexdigest()
            out.assets[sha] = raw or b""
            out.blocks.append(Block(f"[Image {head.get('Width')}x{head.get('Height')}]", "image", number, metadata={"sha256": sha, "bbox": box, "source": {"path": name, "page": number, "bbox": box}, "image": {"extracted_path": f"images/{sha}", "sha256": sha}}))
        if drawn >= DRAWINGS:
            out.blocks.append(Block(f"[Vector graphic: {drawn} operators]", "graphic", number, metadata={"operators": drawn, "source": {"path": name, "page": number, "bbox": box}}))
        if not found:
            out.warn(f"Page {number} " + ("is an image without text" if images else "is empty"))
        every.append((number, width, height, rows_of(found, width)))
    classify(out, every, name)
    out.blocks.sort(key=lambda b: b.page or 0)
    return out


def body_size(rows: list[dict]) -> float:
    """The size of most text: a median of sizes, each as often as its row has words, 1 to 20."""
    sizes = sorted(r["size"] for r in rows for _ in range(min(20, max(1, len(r["text"].split())))))
    n = len(sizes)
    return (sizes[(n - 1) // 2] + sizes[n // 2]) / 2 if n else 0.0


def classify(out: Parsed, pages: list[tuple[int, float, float, list[dict]]], name: str = "") -> None:
    """Blocks of rows: headings (level by the rank of their size), list items, formulas, and paragraphs of rows that follow closely. Each has its file, page
    and box (left, lower, right and upper edge) as its source.
    """
    usual = body_size([r for _, _, _, rows in pages for r in rows])
    is_head = lambda r, height: r["size"] >= max(usual + 1.5, usual * 1.15) and len(r["text"]) <= 180 and r["text"][-1] not in ".;," and MARGIN * height < r["y"] < (1 - MARGIN) * height
    sizes = sorted({round(r["size"]) for _, _, h, rows in pages for r in rows if is_head(r, h)}, reverse=True)
    path: list[str] = []
    for number, _, height, rows in pages:
        last: dict | None = None
        for r in rows:
            box = [r["x"], r["y"], r["end"], r["y"] + r["size"]]
            place = {"x": r["x"], "y": r["y"], "font_size": r["size"], "source": {"path": name, "page": number, "bbox": box}}
            if is_head(r, height):
                level = min(6, sizes.index(round(r["size"])) + 1)
                path = under(path, level, r["text"])
                out.blocks.append(Block(r["text"], "heading", number, list(path), place | {"level": level}))
                last = None
            elif m := LIST_MARK.match(r["text"]):
                out.blocks.append(Block(r["text"], "list_item", number, list(path), place | {"marker": m["mark"]}))
                last = None
            elif FORMULA.match(r["text"]):
                out.blocks.append(Block(r["text"], "formula", number, list(path), place))
                last = None
            elif last is not None and 0 < last["y"] - r["y"] <= 1.6 * max(r["size"], last["size"]) and abs(last["x"] - r["x"]) < 40:
                block = out.blocks[-1]
                block.text = block.text[:-1] + r["text"] if block.text.endswith("-") and r["text"][:1].islower() else f"{block.text}\n{r['text']}"
                was = block.metadata["source"]["bbox"]
                block.metadata["source"]["bbox"] = [min(was[0], box[0]), min(was[1], box[1]), max(was[2], box[2]), max(was[3], box[3])]
                last = r
            else:
                out.blocks.append(Block(r["text"], "paragraph", number, list(path), place))
                last = r
