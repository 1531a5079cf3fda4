"""Bytes of text files to text: byte order marks, UTF-8, UTF-16 without a mark, detection, old code pages, in this order."""

from __future__ import annotations

import codecs
from dataclasses import dataclass, field


class ParseError(ValueError):
    """A file that its parser cannot read."""


@dataclass
class Decoded:
    text: str
    encoding: str
    warnings: list[str] = field(default_factory=list)


#: Marks (the longer first) and code pages, and shares that tell UTF-16 from other bytes.
MARKS = [(codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
CODE_PAGES = ["cp1258", "cp1252"]
NUL_BYTES, NUL_CHARS = 0.2, 0.05


def decode(data: bytes) -> Decoded:
    for mark, encoding in MARKS:
        if data.startswith(mark):
            try:
                return Decoded(data.decode(encoding), encoding)
            except UnicodeDecodeError as error:
                raise ParseError(f"not {encoding} after its mark") from error
    try:
        return Decoded(data.decode("utf-8"), "utf-8")
    except UnicodeDecodeError:
        pass
    guess = (_wide(data) if data.count(0) >= NUL_BYTES * len(data) else None) or _detected(data)
    if guess:
        return guess
    for encoding in CODE_PAGES:
        try:
            text = data.decode(encoding)
        except UnicodeDecodeError:
            continue
        if "\0" not in text:
            return Decoded(text, encoding, [f"Decoded as {encoding}"])
    raise ParseError("text in no known encoding")


def _wide(data: bytes) -> Decoded | None:
    """UTF-16 without a mark, little-endian before big-endian, if its text has few NULs."""
    for encoding in ("utf-16-le", "utf-16-be"):
        try:
            text = data.decode(encoding)
        except UnicodeDecodeError:
            continue
        if text.count("\0") < NUL_CHARS * max(1, len(text)):
            return Decoded(text, encoding, ["UTF-16 without a byte order mark"])
    return None


def _detected(data: bytes) -> Decoded | None:
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return None
    best = from_bytes(data).best()
    if best is None or best.chaos >= 0.2 or best.coherence < 0.2 or best.encoding.replace("_", "-").startswith(("utf-16", "utf-32")):
        return None
    if "\0" in str(best):
        return None
    return Decoded(str(best), best.encoding, [f"Decoded as {best.encoding}"])
