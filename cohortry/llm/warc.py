"""WARC archives: written one gzip member per record, read back sequentially.

The reader never holds more than one block of compressed and one of inflated
bytes: it inflates step by step, finds the end of a member where the inflater
says so, frames each record by its content length and hashes the payload as it
passes. A cut or damaged archive raises; nothing is skipped.

Tasks write to the shared folder under names of their own. Only the files named
by finished tasks, in a written table, are part of an archive set; what a lost
or repeated task leaves behind is never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import batches_of, join_groups, ready
from cohortry.sources.scratch import scratch_path, settle

#: Shorter payloads are always written whole.
MIN_REVISIT_BYTES = 100
#: Compressed bytes after which a task begins its next file.
FILE_BYTES = 256 << 20
_BLOCK = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path for the URI or path of a shared folder."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (
        pafs.LocalFileSystem(), uri)


def record(kind: str, record_id: str, url: str, payload: bytes, digest: str, n_bytes: int,
           refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member. A revisit's block is empty; its headers tell
    digest and length of the payload that it stands for. ``date`` is when the
    record was made, in UTC."""
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>",
            f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
            f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Payload-Length: {n_bytes}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return (packer.compress("\r\n".join(head).encode()) + packer.compress(block)
            + packer.compress(b"\r\n\r\n") + packer.flush())


@dataclass
class Record:
    headers: dict[str, str]
    n_bytes: int = 0
    sha256: str = ""
    payload: bytes = field(default=b"", repr=False)


class WarcError(ValueError):
    """An archive that is cut or does not say what it holds."""


def _members(stream) -> Iterator[bytes | None]:
    """Inflated pieces of at most _BLOCK bytes; None after each gzip member."""
    packed = b""
    while packed := packed or stream.read(_BLOCK):
        inflater = zlib.decompressobj(31)
        while not inflater.eof:
            try:
                piece = inflater.decompress(packed, _BLOCK)
            except zlib.error as error:
                raise WarcError(f"a record is not a whole gzip member: {error}") from error
            packed = inflater.unconsumed_tail
            if piece:
                yield piece
            if not packed and not inflater.eof and len(piece) < _BLOCK:
                packed = stream.read(_BLOCK)
                if not packed:
                    raise WarcError("the archive ends inside a record")
        packed = inflater.unused_data
        yield None


def read_records(stream, keep_payload: bool = False) -> Iterator[Record]:
    """Records of an archive in order; digests and lengths are verified."""
    head, current, left, sha, pieces = bytearray(), None, 0, None, []
    for piece in _members(stream):
        if piece is None:
            if current is None or left != -4:
                raise WarcError("a record is shorter or longer than its content length")
            current.sha256, current.payload = sha.hexdigest(), b"".join(pieces)
            _verify(current)
            yield current
            head, current, left, pieces = bytearray(), None, 0, []
            continue
        if current is None:
            head += piece
            end = head.find(b"\r\n\r\n")
            if end < 0:
                continue
            current = Record(_headers(bytes(head[:end])))
            length = current.headers.get("content-length", "")
            if not (length.isascii() and length.isdigit()):
                raise WarcError(f"a record's content length is {length!r}")
            current.n_bytes = left = int(length)
            sha, piece = hashlib.sha256(), bytes(head[end + 4:])
        body, rest = piece[:max(0, left)], piece[max(0, left):]
        sha.update(body)
        if keep_payload:
            pieces.append(body)
        left -= len(piece)
        if left < -4 or rest.strip(b"\r\n"):
            raise WarcError("other bytes follow a record's content")


def _headers(head: bytes) -> dict[str, str]:
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise WarcError(f"no record begins with {version[:20]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _verify(found: Record) -> None:
    said = found.headers.get("warc-payload-digest", "").removeprefix("sha256:")
    if found.headers.get("warc-type") == "response" and said != found.sha256:
        raise WarcError(f"record {found.headers.get('warc-record-id')} fails its digest")


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                  min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Rows (page_id, url, payload, digest, first_id, first_row, row).

    Of equal payloads of at least ``min_bytes`` bytes the row with the smallest
    id is the first; where rows share that id too, one of them.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    settled = settle(pages.select(
        F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
        payload.alias("payload"), F.sha2(payload, 256).alias("digest"),
        F.monotonically_increasing_id().alias("row")))
    total = settled.count()
    # A null id comes last; the row number tells rows of one id apart.
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    groups = settle(settled.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
        .select("digest", F.col("first.page_id").alias("first_id"),
                F.col("first.row").alias("first_row"), "copies"))
    return join_groups(settled, groups, "digest", "copies", total)


_FILES = pa.schema([("file", pa.string()), ("records", pa.int64())])


def _text(value: str | None) -> str:
    """A header value: no line breaks, as they would end the header."""
    return " ".join((value or "").split())


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        out, name, size, n = None, "", 0, 0
        done = []
        for batch in batches:
            for page, row, url, payload, digest, first, first_row in zip(
                    *(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                again = first_row is not None and first_row != row
                packed = record("revisit" if again else "response", f"page:{page}", _text(url),
                                payload, digest, len(payload), f"page:{first}" if again else None, date)
                out.write(packed)
                size, n = size + len(packed), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n))
        yield from batches_of(done, _FILES)
    return run


def write_archives(marked: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Write the rows of ``with_revisits``; the written table (file, records). All
    records of a call have one date: ``date``, or the time of the call."""
    ready(marked.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return settle(marked.select("page_id", "row", "url", "payload", "digest", "first_id", "first_row")
                  .mapInArrow(_write(folder, date), "file string, records bigint"))


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("record_type", pa.string()),
                   ("refers_to", pa.int64()), ("url", pa.string())])


def _page(name: str | None) -> int | None:
    number = (name or "").strip("<>").removeprefix("page:")
    return int(number) if number not in ("", "None") else None


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name, records in zip(*(c.to_pylist() for c in batch.columns)):
                    n = 0
                    with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                        for r in read_records(stream):
                            h, n = r.headers, n + 1
                            # The framed length; a revisit's block is empty.
                            n_bytes = (int(h["x-payload-length"]) if h["warc-type"] == "revisit"
                                       else r.n_bytes)
                            yield (_page(h["warc-record-id"]), n_bytes,
                                   h["warc-payload-digest"].removeprefix("sha256:"),
                                   h["warc-type"], _page(h.get("warc-refers-to")),
                                   h["warc-target-uri"])
                    if n != records:
                        raise WarcError(f"{name} has {n} records instead of {records}")

        yield from batches_of(rows(), _READ)
    return run


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """One row per record of the files, each file read by one task."""
    return (files.repartition(max(1, files.count()), "file").select("file", "records")
            .mapInArrow(_read(folder), "page_id bigint, payload_bytes bigint, payload_digest string, "
                                       "record_type string, refers_to bigint, url string"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read the archives back.

    Null html is an empty payload. A null id is written as 'None' and read as
    null; a null URL becomes empty, and white space in a URL one blank. Of rows
    that share id and payload one is the response and the others revisit it. An
    empty table gives no files and no rows. Other columns are not stored.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(with_revisits(pages), folder), folder)
