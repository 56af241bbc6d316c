"""WARC archives of web pages: a writer, and a sequential reader.

An archive is a row of gzip members, one for each record. The reader feeds a file in chunks to an
incremental zlib decompressor, starts a new one where a member ends, takes a record's block by its
Content-Length and checks digests; memory holds one record at a time. The writer stores a payload
once: of records with equal payloads of `least` bytes or more one is a response, the others are
revisits that refer to it.

Archives are files in a shared folder, reached through pyarrow's file systems (a local path, or a
URI that pyarrow knows). A task writes under names of its own attempt and reports them; only
reported archives are read, so a repeated or lost task leaves at most unused files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Scratch

ROLL = 64_000_000  # bytes after which a task starts another archive
EOL = b"\r\n"


class WarcError(ValueError):
    """A record that breaks the format or fails its digest."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)

    @property
    def type(self) -> str:
        return self.headers["warc-type"]

    @property
    def payload(self) -> bytes:
        """What follows the HTTP header of a block."""
        return self.block.partition(EOL + EOL)[2]


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + EOL + EOL) + packer.flush()


def _line(value: str) -> str:
    """A header's value: control characters would break the framing."""
    return "".join(c for c in value if c >= " ")


def page_record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None) -> bytes:
    """A response, or a revisit of refers_to's payload, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", _line(url or "urn:page:unknown")),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", digest or sha1_label(payload)),
        ("WARC-Block-Digest", sha1_label(block)),
    ]
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", str(refers_to))]
    return _member(headers, block)


class Members:
    """The decompressed bytes of a stream of gzip members, read forward."""

    def __init__(self, stream: BinaryIO, chunk: int = 1 << 16):
        self.stream, self.chunk = stream, chunk
        self.raw, self.data, self.unpacker = b"", bytearray(), None

    def next_member(self) -> bool:
        """Moves to the next member; false at the end of the stream."""
        if not self.raw:
            self.raw = self.stream.read(self.chunk)
        self.unpacker = zlib.decompressobj(31) if self.raw else None
        self.data = bytearray()
        return self.unpacker is not None

    def _more(self) -> bool:
        """Decompresses a bounded piece; false at the member's end."""
        u = self.unpacker
        if u.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(self.chunk)
            if not self.raw:
                raise WarcError("the archive ends inside a member")
        try:
            self.data += u.decompress(self.raw, self.chunk * 4)
        except zlib.error as e:
            raise WarcError(f"a member can't be decompressed: {e}") from e
        self.raw = u.unused_data if u.eof else u.unconsumed_tail
        return True

    def until(self, end: bytes, most: int = 1 << 20) -> bytes:
        seen = 0
        while (at := self.data.find(end, max(0, seen - len(end)))) < 0:
            seen = len(self.data)
            if seen > most or not self._more():
                raise WarcError("no end of the header")
        out = bytes(self.data[:at])
        del self.data[: at + len(end)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.data) < n:
            if not self._more():
                raise WarcError("a record is shorter than its Content-Length")
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def rest(self) -> bytes:
        while self._more():
            pass
        return bytes(self.data)


def _fields(head: str) -> dict[str, str]:
    out, last = {}, None
    for line in head.split("\r\n"):
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            k, _, v = line.partition(":")
            last = k.strip().lower()
            out[last] = v.strip()
    return out


def read_records(stream: BinaryIO, verify: bool = True, chunk: int = 1 << 16) -> Iterator[Record]:
    """The archive's records in order. Raises WarcError on bad framing and, if `verify`, on wrong digests."""
    members = Members(stream, chunk)
    while members.next_member():
        head = members.until(EOL + EOL).decode("utf-8")
        version, _, rest = head.partition("\r\n")
        if not version.startswith("WARC/"):
            raise WarcError(f"not a WARC record: {version[:20]!r}")
        headers = _fields(rest)
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("no Content-Length") from e
        record = Record(headers, members.exactly(length))
        if members.rest() != EOL + EOL:
            raise WarcError("a record must end in two line ends, and its member with it")
        if record.block.startswith(b"HTTP/"):
            record.http = _fields(record.block.partition(EOL + EOL)[0].decode("utf-8", "replace"))
        if verify:
            _check(record)
        yield record


def _check(record: Record) -> None:
    expected = record.headers.get("warc-block-digest")
    if expected and expected != sha1_label(record.block):
        raise WarcError("wrong block digest")
    expected = record.headers.get("warc-payload-digest")
    if expected and record.type == "response" and expected != sha1_label(record.payload):
        raise WarcError("wrong payload digest")


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_archives(pages: DataFrame, folder: str, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row; returns (archive, records, bytes) lazily: keep it as a table, the writing is its evaluation.

    Equal payloads meet through sums by digest (SHA-1 and length), of which only groups are joined
    back to the pages; so a group may hold any share of the rows.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("payload"), F.sha1(html).alias("digest"), F.octet_length(html).alias("n"))
    long_ = rows.where(F.col("n") >= least)
    groups = long_.groupBy("digest", "n").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1 and response is not null")
    decided = rows.join(groups.drop("copies"), ["digest", "n"], "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("response")), F.lit(None)).otherwise(F.col("response"))
    decided = decided.select("page_id", "url", "payload", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _files(folder)
        files.create_dir(base, recursive=True)
        out, name, count, size, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, count, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                member = page_record(page_id, url, payload or b"", refers_to)
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= ROLL:
                    out.close()
                    done.append((name, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count, size))
        if done:
            names, counts, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x in names]), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["archive", "records", "bytes"])

    return decided.mapInArrow(run, "archive string, records long, bytes long")


def read_archives(archives: DataFrame, payloads: bool = True, verify: bool = True) -> DataFrame:
    """The records of the archives (column `archive`), an archive a task at a time.

    page_id, url, record_type, refers_to, payload_bytes, payload_digest (hex SHA-1) and, if asked
    for, payload (null for revisits). Length and digest are those of the full payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payloads
            names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path in batch.column("archive").to_pylist():
                files, base = _files(path)
                rows, size = [], 0
                with files.open_input_stream(base, compression=None) as stream:
                    for record in read_records(stream, verify):
                        h = record.headers
                        page = int(h["warc-page-id"]) if h.get("warc-page-id") else None
                        refers = int(h["warc-refers-to-page-id"]) if "warc-refers-to-page-id" in h else None
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        rows.append((page, h.get("warc-target-uri"), record.type, refers, int(record.http["content-length"]), digest) + ((record.payload if record.type == "response" else None),) * payloads)
                        size += len(record.block) if payloads else 0
                        if len(rows) >= 2000 or size > 8_000_000:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    # an archive is up to ROLL bytes of work: deal them out one by one, which adaptive execution leaves as it is
    tasks = min(max(1, archives.count()), 100_000)
    return archives.select("archive").repartition(tasks).mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 1000, payloads: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Pages written to archives in the scratch folder and read back: a row for each row of pages.

    A null html is an empty payload. Of rows with equal payloads of `least` bytes or more, that with
    the largest page_id is the response and the others revisit it; rows that repeat that page_id too
    are responses. Rows with a null page_id revisit a group's response if there is one. Other
    columns are left out; an empty table gives an empty one.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    archives = scratch.table(write_archives(pages, scratch.path("archives"), least), "manifest")
    return read_archives(archives, payloads)
