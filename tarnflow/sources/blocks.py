"""What parsers return: blocks of text with a kind, a page, headings and metadata, and warnings."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Block:
    text: str
    kind: str = "paragraph"
    page: int | None = None
    heading_path: list[str] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)


@dataclass
class Parsed:
    media_type: str
    blocks: list[Block] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    assets: dict[str, bytes] = field(default_factory=dict)  # by SHA-256

    def warn(self, text: str) -> None:
        if text not in self.warnings:
            self.warnings.append(text)


def under(path: list[str], level: int, title: str) -> list[str]:
    """The headings in force after one of this level (from 1)."""
    return [*path[: level - 1], title]
