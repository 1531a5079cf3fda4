"""Files as tables: discovery, guards, parsers by extension, blocks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Ingestion
from .blocks import Parsed
from .decode import ParseError
from .docx import parse_docx
from .markdown import parse_markdown
from .pdf import parse_pdf
from .text import parse_text

Parser = Callable[[bytes, str], Parsed]
PARSED = "source_path string, document_id string, content_hash string, media_type string, encoding string, error string, warnings array<string>, metadata string, blocks array<struct<ordinal:int,text:string,kind:string,page:int,heading_path:array<string>,metadata:string>>, assets array<struct<sha256:string,content:binary>>"


class Registry:
    """Parsers by extension. A later registration of an extension takes its place."""

    def __init__(self) -> None:
        self.parsers: dict[str, Parser] = {}
        self.names: dict[str, str] = {}

    def register(self, extensions: list[str], parser: Parser, signature: str) -> None:
        for x in extensions:
            self.parsers[x.lower()] = parser
            self.names[x.lower()] = signature

    def extensions(self) -> list[str]:
        return sorted(self.parsers)

    def signatures(self) -> dict[str, str]:
        return dict(sorted(self.names.items()))

    def parser_for(self, path: str) -> Parser:
        dot = path.rpartition("/")[2].rpartition(".")
        found = self.parsers.get(f".{dot[2].lower()}") if dot[1] else None
        if found is None:
            raise ParseError(f"no parser for {path}; supported: {', '.join(self.extensions())}")
        return found


def default_registry(config: Ingestion = Ingestion()) -> Registry:
    out = Registry()
    out.register([".txt"], parse_text, "text-1")
    out.register([".md", ".markdown"], parse_markdown, "markdown-1")
    out.register([".docx"], partial(parse_docx, limit=config.max_unzipped_bytes), "docx-1")
    out.register([".pdf"], partial(parse_pdf, max_pages=config.max_pdf_pages), "pdf-1")
    return out


def discover(spark: SparkSession, path: str, registry: Registry | None = None, recursive: bool = True) -> DataFrame:
    """path, length, modificationTime, content of files with a registered extension. Content is read only where selected; order names where they are shown."""
    names = (registry or default_registry()).extensions()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    ext = F.lower(F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1)))
    return found.where(ext.isin(names))


def guarded(files: DataFrame, config: Ingestion = Ingestion()) -> tuple[DataFrame, DataFrame]:
    """Files that may be read, and rejects with a reason. The size is tested before content is."""
    reason = F.when(F.col("length") > config.max_file_bytes, "too large").when(F.col("length") == 0, "empty")
    marked = files.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("path", "length", "reason")


def parse(files: DataFrame, registry: Registry | None = None, config: Ingestion = Ingestion()) -> DataFrame:
    """files: path, content. A PARSED row per file; a file that cannot be read has its error and no blocks. One pass, no shuffle. assets: bytes of
    images by their SHA-256.
    """
    parsers = registry or default_registry(config)

    def one(path: str, content: bytes) -> dict:
        row = {"source_path": path, "document_id": hashlib.sha256(path.encode()).hexdigest()[:24], "content_hash": hashlib.sha256(content).hexdigest(), "media_type": None, "encoding": None, "error": None, "warnings": [], "metadata": "{}", "blocks": [], "assets": []}
        try:
            got = parsers.parser_for(path)(content, path)
        except ParseError as error:
            return row | {"error": str(error)}
        dump = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, default=str)
        blocks = [{"ordinal": i, "text": b.text, "kind": b.kind, "page": b.page, "heading_path": b.heading_path, "metadata": dump(b.metadata)} for i, b in enumerate(got.blocks)]
        assets = [{"sha256": sha, "content": data} for sha, data in sorted(got.assets.items())]
        return row | {"assets": assets, "media_type": got.media_type, "encoding": got.metadata.get("encoding"), "warnings": got.warnings, "metadata": dump(got.metadata), "blocks": blocks, "error": None if blocks else "no text"}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [one(p, bytes(c)) for p, c in zip(part["path"], part["content"], strict=True)]
            if rows:
                yield pd.DataFrame(rows)

    return files.select("path", "content").mapInPandas(run, PARSED)


def blocks_of(parsed: DataFrame) -> DataFrame:
    """document_id and a row per block, ready for operators.blocks."""
    return parsed.select("document_id", F.explode("blocks").alias("b")).select("document_id", "b.*")


HASH_PIECE = 1 << 20


def hashes(paths: DataFrame) -> DataFrame:
    """paths: source_path. source_path, content_hash of each file that is there, read piece by piece in the tasks; files that are gone have no row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path in part["source_path"]:
                fs, name = (pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)
                if fs.get_file_info(name).type != pafs.FileType.File:
                    continue
                own = hashlib.sha256()
                with fs.open_input_stream(name) as f:
                    while piece := f.read(HASH_PIECE):
                        own.update(piece)
                rows.append((path, own.hexdigest()))
            yield pd.DataFrame(rows, columns=["source_path", "content_hash"])

    return paths.select("source_path").distinct().mapInPandas(run, "source_path string, content_hash string")
