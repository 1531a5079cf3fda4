"""WARC archives: writing, and a normaliser of archives that are one gzip stream.

Such an archive can only be read from its start. The normaliser inflates the stream once, in pieces of bounded size, writes every record as a
gzip member of its own, and beside the new archive an index of one line a record: offset, length, type, record id. Any record can then be
read alone. One task handles one archive; no record need fit in memory.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, remove, short_batches, written
from .files import fresh, make_dir, opened

PIECE = 1 << 20
ARCHIVE_BYTES = 64_000_000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
NAMES = uuid.UUID("6f1cbd5e-6c1b-4d0f-9a51-0f2f8d4f7c11")


def _record_id(page_id: int | None, unique: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'page {page_id}{unique}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, when: str) -> bytes:
    """A response record, or where refers is given a revisit of that page's record, which leaves the payload out."""
    revisit = refers is not None
    block = HTTP % len(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {when}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers)}", f"X-Refers-To-Page-ID: {refers}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Inflated:
    """Bytes of a gzip file of one or more members, inflated once from the start and held no longer than they are needed."""

    def __init__(self, source: BinaryIO):
        self._source, self._have, self._zip, self._raw = source, bytearray(), zlib.decompressobj(31), b""

    def _more(self) -> bool:
        while True:
            if self._zip.eof:
                rest = self._zip.unused_data
                self._raw, self._zip = rest, zlib.decompressobj(31)
            data = self._raw or self._zip.unconsumed_tail or self._source.read(PIECE)
            self._raw = b""
            if not data:
                return False
            got = self._zip.decompress(data, 4 * PIECE)
            if got:
                self._have += got
                return True

    def until(self, mark: bytes) -> bytes:
        """Through the next mark; b"" at the end of the stream."""
        start = 0
        while (at := self._have.find(mark, start)) < 0:
            start = max(0, len(self._have) - len(mark))
            if not self._more():
                if self._have.strip():
                    raise ValueError("the archive ends within a record's header")
                return b""
        return self._take(at + len(mark))

    def _take(self, n: int) -> bytes:
        out = bytes(self._have[:n])
        del self._have[:n]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes, piece by piece."""
        while n:
            if not self._have and not self._more():
                raise ValueError("the archive ends within a record")
            part = self._take(min(n, len(self._have)))
            n -= len(part)
            yield part


def fields(head: bytes) -> dict[str, str]:
    """Named fields of a header, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:] if x)}


def normalise(source: BinaryIO, archive: BinaryIO, index: BinaryIO, level: int = 1) -> int:
    """Rewrite a whole-stream archive as a member per record, with an index. Returns the number of records."""
    stream, offset, count = Inflated(source), 0, 0
    while head := stream.until(b"\r\n\r\n"):
        head = head.lstrip(b"\r\n")
        named = fields(head)
        member, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        left = int(named["content-length"])
        length += archive.write(member.compress(head))
        for part in stream.pieces(left + 4):  # two line ends close a record
            length += archive.write(member.compress(part))
        length += archive.write(member.flush())
        index.write(f"{offset} {length} {named.get('warc-type', '-')} {named.get('warc-record-id', '-')}\n".encode())
        offset += length
        count += 1
    return count


def write_archives(records: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """records: page_id, url, html, digest (base32), refers_to. Writes archives of one gzip stream each; returns their names, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, size, pack = None, "", 0, None
        when = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

        def done() -> pa.RecordBatch:
            out.write(pack.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name]})

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                page_id, url, html, digest, refers = (x.as_py() for x in row)
                if out is None:
                    make_dir(folder)
                    name, size, pack = fresh(folder, ".whole.warc.gz"), 0, zlib.compressobj(level, zlib.DEFLATED, 31)
                    fs, path = opened(name)
                    out = fs.open_output_stream(path, compression=None, buffer_size=PIECE)
                data = record(page_id, url, (html or "").encode(), digest, refers, when)
                out.write(pack.compress(data))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return written(records.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "file string"), "archives")


def normalise_archives(files: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """files: file string, archives of one gzip stream. Writes normalised ones and their indexes; returns archive, index, records, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                make_dir(folder)
                name = fresh(folder, ".warc.gz")
                fs, path = opened(name)
                old, old_path = opened(file)
                with old.open_input_stream(old_path, compression=None) as source, fs.open_output_stream(path, compression=None, buffer_size=PIECE) as archive, fs.open_output_stream(path + ".idx", compression=None, buffer_size=PIECE) as index:
                    n = normalise(source, archive, index, level)
                yield pa.RecordBatch.from_pydict({"archive": [name], "index": [name + ".idx"], "records": [n]})

    parts = max(1, min(files.count(), int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return written(files.select("file").repartition(parts, "file").mapInArrow(run, "archive string, index string, records long"), "normalised")


def read_archives(archives: DataFrame) -> DataFrame:
    """archives: archive, index. A row per record, each read alone at its place in the index: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to. The size of a revisit's payload is that of its HTTP header; digests of responses are taken from what was read.
    """
    import hashlib

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = opened(archive)
                rows: list[dict] = []
                with fs.open_input_file(path) as f, fs.open_input_stream(opened(index)[1], compression=None) as lines:
                    for line in lines.read().splitlines():
                        offset, length, kind, _ = line.decode().split(" ")
                        data = zlib.decompress(f.read_at(int(length), int(offset)), 31)
                        head, _, block = data.partition(b"\r\n\r\n")
                        named = fields(head)
                        http, _, payload = block[: int(named["content-length"])].partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest = named["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response":
                            if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"a record of {archive} at {offset} does not match its digest")
                        rows.append({"page_id": number(named.get("x-page-id")), "url": named.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(named.get("x-refers-to-page-id"))})
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive", "index").repartition(parts, "archive").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def with_digests(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null: empty), digest (base32 SHA-1), refers_to: of pages of equal payloads of at least least_bytes the smallest
    page_id, on the others. A null page_id is never the smallest; rows that share the smallest are all responses.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    brief = p.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("sha"), F.octet_length("html").alias("n")).where(F.col("n") >= least_bytes)
    first = brief.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("pages")).where("pages > 1 and refers_to is not null")
    again = brief.join(first, "sha").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.xxhash64("page_id", "sha").alias("key"), "refers_to").groupBy("key").agg(F.first("refers_to").alias("refers_to"))
    full = p.withColumn("sha", F.sha1(F.encode("html", "UTF-8"))).withColumn("key", F.xxhash64("page_id", "sha"))
    bits = F.lpad(F.conv(F.substring("sha", 1, 10), 16, 2), 40, "0")
    for i in range(1, 4):
        bits = F.concat(bits, F.lpad(F.conv(F.substring("sha", 10 * i + 1, 10), 16, 2), 40, "0"))
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    digest = F.concat(*(F.substring(letters, F.conv(F.substring(bits, 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)))
    return full.join(again, "key", "left").select("page_id", "url", "html", digest.alias("digest"), "refers_to")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages as whole-stream archives, normalise these, and read every record back by its index."""
    spark = pages.sparkSession
    short_batches(spark)
    whole, folder = new_path(spark, "whole"), new_path(spark, "warc")
    files = write_archives(with_digests(pages, least_bytes), whole)
    archives = normalise_archives(files, folder)
    remove(spark, whole)
    return read_archives(archives)
