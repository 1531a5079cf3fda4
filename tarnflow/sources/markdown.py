"""Markdown to blocks: a line-based reader of the common constructs, without a Markdown library.

Front matter, headings (# and underlined), fenced and indented code, colon fences (admonitions), block quotes, lists with tasks and nesting, tables,
definition lists, footnotes, HTML blocks, images and paragraphs; within them bold, italic, strike, code, links, images and footnote
references, whose marks are taken out of the text and kept as spans. Every block knows its lines and characters in the file.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from .blocks import Block, Parsed, under
from .decode import decode

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$")
COLONS = re.compile(r"^ {0,3}(:{3,})\s*(\S.*)?$")
HEADING = re.compile(r"^ {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
RULE = re.compile(r"^ {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")
ITEM = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])(?:\s+(.*))?$")
TASK = re.compile(r"^\[([ xX])\]\s+")
QUOTE = re.compile(r"^ {0,3}>\s?(.*)$")
FOOTNOTE = re.compile(r"^\[\^([^\]\s]+)\]:\s*(.*)$")
DEFINITION = re.compile(r"^:\s+(.*)$")
LINK_DEFINITION = re.compile(r"^ {0,3}\[([^\]^][^\]]*)\]:\s*<?(\S+?)>?(?:\s+[\"'(].*[\"')])?\s*$")
DELIMITER = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
HTML_BLOCK = re.compile(r"^ {0,3}<(?:/?[a-zA-Z][\w-]*(?:[\s/>]|$)|!--)")
INLINE = re.compile(
    r"(?P<code>`+)(?P<code_text>.+?)(?P=code)(?!`)|!\[(?P<alt>[^\]]*)\]\((?P<src>[^)\s]*)(?:\s+\"[^\"]*\")?\)|\[\^(?P<note>[^\]\s]+)\]|\[(?P<link>[^\]]+)\](?:\((?P<href>[^)\s]*)(?:\s+\"[^\"]*\")?\)|\[(?P<ref>[^\]]*)\])"
    r"|(?P<b>\*\*|__)(?=\S)(?P<b_text>.+?)(?<=\S)(?P=b)(?!\*)|~~(?=\S)(?P<s_text>.+?)(?<=\S)~~|(?P<i>\*|(?<!\w)_)(?=\S)(?P<i_text>.+?)(?<=\S)(?P=i)(?!\w)|(?P<html></?[a-zA-Z][^>]*>)|\\(?P<escaped>[!-/:-@\[-`{-~])",
    re.S,
)
LINE_TAGS = frozenset("address article aside blockquote br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class _Fragment(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in LINE_TAGS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in LINE_TAGS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def fragment_text(html: str) -> str:
    """Text of a piece of HTML, a line per block, without scripts and styles."""
    reader = _Fragment()
    reader.feed(html)
    reader.close()
    return "\n".join(x for x in (line.strip() for line in "".join(reader.out).splitlines()) if x)


def inline(text: str, references: dict[str, str]) -> tuple[str, dict]:
    """Text without marks; and spans of formatting, links, images and footnote references, by their places in it."""
    out, marks = "", {"formatting": [], "links": [], "images": [], "footnotes": [], "unresolved": []}

    def put(part: str, kind: str | None = None, **more: object) -> None:
        nonlocal out
        start = len(out)
        inner, below = inline(part, references)
        out += inner
        for name, spans in below.items():
            marks[name] += [s | {"start": s["start"] + start, "end": s["end"] + start} if isinstance(s, dict) else s for s in spans]
        if kind:
            marks[kind].append({"start": start, "end": len(out), **more})

    at = 0
    for m in INLINE.finditer(text):
        out += text[at : m.start()]
        at = m.end()
        if m["code"]:
            start = len(out)
            out += m["code_text"].strip()
            marks["formatting"].append({"start": start, "end": len(out), "style": "inline_code"})
        elif m["src"] is not None:
            start = len(out)
            out += m["alt"]
            marks["images"].append({"start": start, "end": len(out), "alt": m["alt"], "src": m["src"]})
        elif m["note"]:
            marks["footnotes"].append({"start": len(out), "end": len(out), "label": m["note"]})
        elif m["link"]:
            target = m["href"] if m["href"] is not None else references.get((m["ref"] or m["link"]).casefold())
            if target is None:
                marks["unresolved"].append(m["ref"] or m["link"])
                out += m[0]
            else:
                put(m["link"], "links", href=target)
        elif m["b_text"]:
            put(m["b_text"], "formatting", style="bold")
        elif m["s_text"]:
            put(m["s_text"], "formatting", style="strike")
        elif m["i_text"]:
            put(m["i_text"], "formatting", style="italic")
        elif m["html"]:
            out += "\n" if m["html"].strip("</ >").lower().startswith("br") else ""
        else:
            out += m["escaped"]
    return out + text[at:], marks


def _cells(line: str) -> list[str]:
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", line.strip().strip("|") if not line.strip().endswith("\\|") else line.strip().lstrip("|"))]


class _Reader:
    def __init__(self, text: str, name: str):
        self.out = Parsed("text/markdown")
        self.name = name
        self.lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.path: list[str] = []
        self.references = {m[1].casefold(): m[2] for x in self.lines if (m := LINK_DEFINITION.match(x))}

    def span(self, a: int, z: int) -> dict:
        """Lines a to z - 1 as a place in the file."""
        return {"path": self.name, "start_line": a + 1, "end_line": z, "start_char": self.starts[a], "end_char": max(self.starts[a], self.starts[z] - 1)}

    def add(self, kind: str, text: str, a: int, z: int, raw: bool = False, **more: object) -> None:
        marks: dict = {}
        if not raw:
            text, found = inline(text, self.references)
            for label in found.pop("unresolved"):
                self.out.warn(f"Unresolved reference link: {label}")
            marks = {k: v for k, v in found.items() if v}
        if text.strip():
            self.out.blocks.append(Block(text.strip("\n"), kind, heading_path=list(self.path), metadata={"source": self.span(a, z), **marks, **more}))
        for image in marks.get("images", []):
            remote = bool(re.match(r"(?:https?:)?//|data:", image["src"]))
            self.out.blocks.append(Block(f"[Image: {image['alt'] or image['src']}]", "image", heading_path=list(self.path), metadata={"source": self.span(a, z), "src": image["src"], "remote": remote}))

    def run(self) -> Parsed:
        i = self.front_matter()
        while i < len(self.lines):
            i = self.block(i)
        return self.out

    def front_matter(self) -> int:
        if not self.lines or self.lines[0].strip() != "---":
            return 0
        for k in range(1, len(self.lines)):
            if self.lines[k].strip() in ("---", "..."):
                raw = "\n".join(self.lines[1:k])
                try:
                    import yaml

                    value = yaml.safe_load(raw)
                except ImportError:
                    value = raw
                except Exception:
                    self.out.warn("Front matter is not valid YAML")
                    value = raw
                self.out.metadata["front_matter"] = value
                return k + 1
        self.out.warn("Unclosed front matter")
        return 0

    def block(self, i: int) -> int:
        line = self.lines[i]
        if not line.strip():
            return i + 1
        for reader in (self.fence, self.colons, self.heading, self.quote, self.footnote, self.table, self.item, self.html, self.code):
            if (z := reader(i)) is not None:
                return z
        if RULE.match(line) or LINK_DEFINITION.match(line):
            return i + 1
        return self.paragraph(i)

    def fence(self, i: int) -> int | None:
        if not (m := FENCE.match(self.lines[i])):
            return None
        mark = m[1]
        for k in range(i + 1, len(self.lines)):
            if (e := self.lines[k].strip()) and set(e) == {mark[0]} and len(e) >= len(mark):
                break
        else:
            self.out.warn(f"Unclosed code fence at line {i + 1}")
            k = len(self.lines)
        self.add("code", "\n".join(self.lines[i + 1 : k]), i, min(k + 1, len(self.lines)), raw=True, language=m[2].strip() or None)
        return k + 1

    def colons(self, i: int) -> int | None:
        m = COLONS.match(self.lines[i])
        if not m or not m[2]:
            return None
        for k in range(i + 1, len(self.lines)):
            if (e := self.lines[k].strip()) and set(e) == {":"} and len(e) >= len(m[1]):
                break
        else:
            self.out.warn(f"Unclosed fence at line {i + 1}")
            k = len(self.lines)
        self.add("admonition", "\n".join(self.lines[i + 1 : k]), i, min(k + 1, len(self.lines)), label=m[2].strip("{} "))
        return k + 1

    def heading(self, i: int) -> int | None:
        if m := HEADING.match(self.lines[i]):
            return self.titled(len(m[1]), m[2] or "", i, i + 1)
        below = self.lines[i + 1] if i + 1 < len(self.lines) else ""
        if re.fullmatch(r" {0,3}(=+|-+)\s*", below) and not ITEM.match(self.lines[i]) and not QUOTE.match(self.lines[i]) and "|" not in self.lines[i]:
            return self.titled(1 if "=" in below else 2, self.lines[i].strip(), i, i + 2)
        return None

    def titled(self, level: int, title: str, a: int, z: int) -> int:
        plain = inline(title, self.references)[0].strip()
        self.path = under(self.path, level, plain) if plain else self.path
        self.add("heading", title, a, z, level=level)
        return z

    def quote(self, i: int) -> int | None:
        if not QUOTE.match(self.lines[i]):
            return None
        k = i
        while k < len(self.lines) and self.lines[k].strip() and (QUOTE.match(self.lines[k]) or k > i):
            k += 1
        self.add("blockquote", "\n".join((m[1] if (m := QUOTE.match(x)) else x) for x in self.lines[i:k]), i, k)
        return k

    def footnote(self, i: int) -> int | None:
        if not (m := FOOTNOTE.match(self.lines[i])):
            return None
        k = i + 1
        while k < len(self.lines) and re.match(r"(?: {2,}|\t)\S", self.lines[k]):
            k += 1
        self.add("footnote", "\n".join([m[2], *(x.strip() for x in self.lines[i + 1 : k])]), i, k, label=m[1])
        return k

    def table(self, i: int) -> int | None:
        if "|" not in self.lines[i] or i + 1 >= len(self.lines):
            return None
        below = self.lines[i + 1]
        head = _cells(self.lines[i])
        if not DELIMITER.match(below) or "-" not in below:
            if re.fullmatch(r"[\s|:-]+", below) and "-" in below:
                self.out.warn(f"Malformed table delimiter at line {i + 2}")
            return None
        marks = _cells(below)
        if len(marks) != len(head):
            self.out.warn(f"Malformed table delimiter at line {i + 2}")
            return None
        align = [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((c.startswith(":"), c.endswith(":"))) for c in marks]
        k = i + 2
        while k < len(self.lines) and "|" in self.lines[k] and self.lines[k].strip():
            k += 1
        rows = [head, *(_cells(x) for x in self.lines[i + 2 : k])]
        cells = [[{"text": inline(c, self.references)[0], "header": r == 0, "align": align[j] if j < len(align) else None} for j, c in enumerate(row[: len(head)] + [""] * (len(head) - len(row)))] for r, row in enumerate(rows)]
        self.add("table", "\n".join(" | ".join(c["text"] for c in row) for row in cells), i, k, raw=True, rows=cells)
        return k

    def item(self, i: int) -> int | None:
        m = ITEM.match(self.lines[i])
        if not m or RULE.match(self.lines[i]):
            return None
        text, k = [m[3] or ""], i + 1
        while k < len(self.lines) and self.lines[k].strip() and not ITEM.match(self.lines[k]) and not FENCE.match(self.lines[k]) and not HEADING.match(self.lines[k]):
            text.append(self.lines[k].strip())
            k += 1
        more: dict = {"level": len(m[1].expandtabs(4)) // 2, "ordered": m[2][0].isdigit(), "marker": m[2]}
        if task := TASK.match(text[0]):
            more["checked"] = task[1] in "xX"
            text[0] = text[0][task.end() :]
        self.add("list_item", "\n".join(text), i, k, **more)
        return k

    def html(self, i: int) -> int | None:
        if not HTML_BLOCK.match(self.lines[i]):
            return None
        k = i
        while k < len(self.lines) and self.lines[k].strip():
            k += 1
        raw = "\n".join(self.lines[i:k])
        self.add("html", fragment_text(raw), i, k, raw=True, html=raw)
        return k

    def code(self, i: int) -> int | None:
        if not re.match(r"(?: {4}|\t)\S", self.lines[i]):
            return None
        k = i
        while k < len(self.lines) and (re.match(r"(?: {4}|\t)", self.lines[k]) or not self.lines[k].strip()):
            k += 1
        while not self.lines[k - 1].strip():
            k -= 1
        self.add("code", "\n".join(re.sub(r"^(?: {4}|\t)", "", x) for x in self.lines[i:k]), i, k, raw=True, language=None)
        return k

    def paragraph(self, i: int) -> int:
        k = i + 1
        while k < len(self.lines) and self.lines[k].strip() and not any(p.match(self.lines[k]) for p in (FENCE, COLONS, HEADING, QUOTE, RULE, DEFINITION, FOOTNOTE)) and not ((m := ITEM.match(self.lines[k])) and m[3] and (not m[2][0].isdigit() or m[2][:-1] == "1")):
            if k + 1 < len(self.lines) and "|" in self.lines[k] and DELIMITER.match(self.lines[k + 1]) and "|" in self.lines[k + 1]:
                break
            k += 1
        if k < len(self.lines) and DEFINITION.match(self.lines[k]):
            self.add("definition_term", "\n".join(x.strip() for x in self.lines[i:k]), i, k)
            while k < len(self.lines) and (m := DEFINITION.match(self.lines[k])):
                self.add("definition", m[1], k, k + 1)
                k += 1
            return k
        self.add("paragraph", "\n".join(x.strip() for x in self.lines[i:k]), i, k)
        return k


def parse_markdown(data: bytes, name: str = "") -> Parsed:
    decoded = decode(data)
    out = _Reader(decoded.text, name).run()
    out.metadata["encoding"] = decoded.encoding
    out.warnings = [*decoded.warnings, *out.warnings]
    return out
