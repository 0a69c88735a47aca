"""WARC archives: written one gzip member per record, read back as a sequence of records.

The writer runs in the tasks that hold the pages and puts archives into a shared folder; a name holds
the task attempt's number, so a task that runs twice leaves an archive that no manifest names. The reader
streams an archive in chunks: zlib inflates member after member, Content-Length frames each
block and both digests are verified.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, written

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads under this many bytes are never revisits.
REVISIT_BYTES = 100
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive breaks the format."""


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes

    def http(self) -> tuple[dict[str, str], bytes]:
        """HTTP headers (lower-case names) and payload of the block."""
        head, mark, payload = self.block.partition(b"\r\n\r\n")
        if not mark:
            raise WarcError("an HTTP block without end of headers")
        return parse_headers(head.split(b"\r\n")[1:]), payload


def record_id(page_id: int | None, digest: str) -> str:
    """The id of a page's record: rows that repeat a page_id, or have none, share one only if their payloads are equal."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def parse_headers(lines: Iterable[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, mark, value = line.decode("utf-8").partition(":")
        if not mark:
            raise WarcError(f"no header: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def header_value(text: str) -> str:
    """The text on one line: control characters and blanks at the ends become percent escapes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block, digest = http if revisit else http + payload, hashlib.sha256(payload).hexdigest()
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": header_value(url or "about:blank"),
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        headers["X-Page-Id"] = str(page_id)
    if revisit:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-Id": str(refers_to)}
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one at a time."""
    inflate, parts, data = zlib.decompressobj(31), [], b""
    begun = False
    while data or (data := stream.read(chunk)):
        begun = True
        try:
            parts.append(inflate.decompress(data))
        except zlib.error as broken:
            raise WarcError(f"a broken gzip member: {broken}") from None
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(parts)
            inflate, parts, begun = zlib.decompressobj(31), [], False
    if begun:
        raise WarcError("the last gzip member is cut short")


def records(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[Record]:
    """The records of an archive in order; WarcError where framing is broken."""
    for data in members(stream, chunk):
        head, mark, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.split(b"\r\n")
        if not mark or not version.startswith(b"WARC/"):
            raise WarcError(f"no WARC record: {data[:40]!r}")
        headers = parse_headers(lines)
        if not re.fullmatch("[0-9]+", headers.get("content-length", "")):
            raise WarcError("a record without Content-Length")
        n = int(headers["content-length"])
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise WarcError(f"Content-Length {n} doesn't frame a block of {len(rest) - 4} bytes")
        yield Record(headers, rest[:n])


def verify(record: Record) -> None:
    """Check the block's digest and, where the payload is there, its digest and length."""
    if record.headers["warc-block-digest"] != f"sha256:{hashlib.sha256(record.block).hexdigest()}":
        raise WarcError("a block doesn't have its digest")
    http, payload = record.http()
    if record.headers["warc-type"] == "response":
        if record.headers["warc-payload-digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
            raise WarcError("a payload doesn't have its digest")
        if int(http["content-length"]) != len(payload):
            raise WarcError("a payload doesn't have its length")


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html (empty for null) with ``refers_to``: of rows with equal html of at least
    REVISIT_BYTES bytes, the smallest page_id, for all others of them; else null.

    Keepers are found by a map-side combined aggregation over digests of payloads that occur twice;
    the join back splits a digest that many pages share. Rows that repeat the smallest page_id are
    all responses; null page_ids are revisits of a row with an id, or responses where there's none.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("_digest", F.sha2("html", 256))
    keepers = (
        own.where(F.octet_length("html") >= REVISIT_BYTES)
        .groupBy(F.col("_digest").alias("_of"))
        .agg(F.min("page_id").alias("_keeper"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    return own.join(keepers, F.col("_digest") == F.col("_of"), "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_keeper")), F.col("_keeper")).alias("refers_to")
    )


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row (page_id, url, html, refers_to) into archives in ``folder``.

    Returns the manifest, a table of path, records and bytes. Each task writes archives of its own.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        done: list[tuple[str, int, int]] = []
        out, path, n = None, "", 0
        for batch in batches:
            ids, urls, refers = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
            for page_id, url, refers_to, html in zip(ids, urls, refers, batch.column("html"), strict=True):
                if out is None:
                    path = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out, n = store.open_output_stream(path), 0
                out.write(member(page_id, url, html.as_py().encode(), refers_to, refers_to is not None))
                n += 1
                if out.tell() >= archive_bytes:
                    done.append((path, n, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((path, n, out.tell()))
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return written(marked.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Read and verify the archives a manifest names: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path, told in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, n = [], 0
                with store.open_input_stream(path, buffer_size=0) as stream:
                    for record in records(stream):
                        verify(record)
                        h = record.headers
                        ids = [int(h[x]) if x in h else None for x in ("x-page-id", "x-refers-to-page-id")]
                        rows.append((ids[0], int(record.http()[0]["content-length"]), h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"], ids[1]))
                        n += 1
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                if n != told:
                    raise WarcError(f"{path} holds {n} records, its manifest says {told}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    archives = manifest.count()
    return manifest.repartition(max(1, archives), "path").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back; a row per page.

    A null html is an empty payload, a null url about:blank. Payloads under REVISIT_BYTES bytes are
    always responses. Other columns are not read; an empty table makes no archive and no row.
    """
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(mark_revisits(pages), folder), folder)
