"""Limits and weights of each step, checked when made. The defaults are fixed values of the behaviour this engine matches."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field


def _require(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Cleaning:
    unicode_form: str = "NFC"
    remove_repeated_margins: bool = True
    margin_min_pages: int = 3
    margin_ratio: float = 0.6


@dataclass(frozen=True)
class Chunking:
    max_chars: int = 1200
    overlap_chars: int = 180
    min_chars: int = 120

    def __post_init__(self) -> None:
        _require(self.max_chars >= 100, "max_chars must be 100 or more")
        _require(0 <= self.overlap_chars < self.max_chars, "overlap_chars must be from 0 to below max_chars")
        _require(0 <= self.min_chars <= self.max_chars, "min_chars must be from 0 to max_chars")


@dataclass(frozen=True)
class Refinement:
    strip_max_chars: int = 360
    strip_max_sentences: int = 2
    batch: int = 12

    def __post_init__(self) -> None:
        _require(self.strip_max_chars >= 80, "strip_max_chars must be 80 or more")
        _require(min(self.strip_max_sentences, self.batch) > 0, "limits of refinement must be positive")


@dataclass(frozen=True)
class WebSearch:
    max_queries: int = 2
    results_per_query: int = 5
    max_pages: int = 5
    passages_per_page: int = 4
    max_strips: int = 8
    max_page_bytes: int = 1_000_000
    max_page_chars: int = 40_000
    max_passages: int = 60
    first_passages: int = 8
    allowed_domains: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _require(1 <= self.max_queries <= 5, "max_queries must be from 1 to 5")
        _require(min(self.results_per_query, self.max_pages, self.passages_per_page, self.max_strips, self.max_page_bytes, self.max_page_chars, self.max_passages) > 0, "limits of web search must be positive")


@dataclass(frozen=True)
class Context:
    max_strips: int = 8
    max_chars: int = 6000
    relevance_weight: float = 0.6
    duplicate_threshold: float = 0.85

    def __post_init__(self) -> None:
        _require(self.max_strips > 0 and self.max_chars > 0, "limits of the context must be positive")
        _require(0 <= self.relevance_weight <= 1, "relevance_weight must be from 0 to 1")
        _require(0 < self.duplicate_threshold <= 1, "duplicate_threshold must be above 0 and at most 1")


@dataclass(frozen=True)
class Answer:
    max_claims: int = 12
    max_claim_chars: int = 700

    def __post_init__(self) -> None:
        _require(self.max_claims > 0, "max_claims must be positive")


@dataclass(frozen=True)
class Ingestion:
    max_file_bytes: int = 50 * 1024 * 1024
    max_pdf_pages: int = 2000
    max_unzipped_bytes: int = 200 * 1024 * 1024
    embedder: str = "hash-64"
    dimensions: int = 64
    #: RRF: score = sum of 1 / (k + rank), ranks from 0.
    rrf_k: int = 2
    cleaning: Cleaning = field(default_factory=Cleaning)
    chunking: Chunking = field(default_factory=Chunking)

    def __post_init__(self) -> None:
        _require(min(self.max_file_bytes, self.max_pdf_pages, self.max_unzipped_bytes, self.dimensions) > 0, "limits of ingestion must be positive")

    def signature(self, parsers: dict[str, str] | None = None, version: str = "10") -> str:
        """One digest for all that shapes an index: rows made under another one are out of date."""
        return canonical_digest({"version": version, "cleaning": asdict(self.cleaning), "chunking": asdict(self.chunking), "embedder": self.embedder, "dimensions": self.dimensions, "parsers": parsers or {}})


def canonical_json(value: object) -> str:
    """Keys sorted, no spaces, non-ASCII as it is."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canonical_digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()
