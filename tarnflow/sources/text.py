"""Plain text: paragraphs between blank lines, with their places in the file."""

from __future__ import annotations

from ..functions.text import paragraph_spans
from .blocks import Block, Parsed
from .decode import decode


def parse_text(data: bytes, name: str = "") -> Parsed:
    decoded = decode(data)
    out = Parsed("text/plain", metadata={"encoding": decoded.encoding}, warnings=list(decoded.warnings))
    for part, a, z, first, last in paragraph_spans(decoded.text):
        out.blocks.append(Block(part, metadata={"source": {"start_line": first, "end_line": last, "start_char": a, "end_char": z}}))
    return out
