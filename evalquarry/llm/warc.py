"""WARC: archives of one gzip member per record, written and read record by record."""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, hot_join, saved

CHUNK = 1 << 16
#: Payloads of fewer bytes are stored however often they occur.
LEAST = 1000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = "path string, position long, record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, digest_ok boolean"


def digest(payload: bytes) -> str:
    """The digest as WARC headers write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def record(name: str, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit that names the record with an equal one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    uri = "".join(c for c in uri or "" if c > " " and c != "\x7f")  # a header value is one line
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", "2000-01-01T00:00:00Z")]
    headers += [("WARC-Target-URI", uri)] if uri else []
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block))]
    headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT)] if refers_to is not None else []
    return member(headers, block)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; Hadoop's names of S3 mean the same store."""
    if "://" not in uri:
        uri = f"file://{os.path.abspath(uri)}"
    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One archive for each partition; it gets its name when it is complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(folder)
        files.create_dir(base, recursive=True)
        first = next(batches, None)
        if first is None:
            return
        name = f"{uuid.uuid4().hex}.warc.gz"
        n = 0
        with files.open_output_stream(f"{base}/{name}.part") as out:
            for batch in _and(first, batches):
                for row in range(len(batch)):
                    page, url, html, to = (batch.column(c)[row].as_py() for c in ("id", "url", "html", "refers_to"))
                    out.write(record(page, url, (html or "").encode(), to))
                n += len(batch)
        files.move(f"{base}/{name}.part", f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n])], names=["path", "records"])

    return run


def _and(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


class Damaged(ValueError):
    """The archive isn't what its framing says."""


@dataclass
class Record:
    position: int
    headers: dict[str, str]
    block: bytes = field(repr=False, default=b"")

    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        return _headers(head.split(b"\r\n")[1:]), body


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines if line)
    return {k.strip().lower().decode(): v.strip().decode() for k, _, v in pairs}


def read(stream: object) -> Iterator[Record]:
    """The records of an archive in turn; no more than one is in memory.

    Each gzip member is inflated piece by piece until its header block is whole,
    then until it has the declared number of bytes; a member that is short, long,
    or lacks the closing two line ends is an error.
    """
    position, held = 0, b""
    while held or (held := stream.read(CHUNK)):
        unpack = zlib.decompressobj(wbits=31)
        got, head_end, length, used = bytearray(), -1, 0, 0
        headers: dict[str, str] = {}
        while not unpack.eof:
            if not held and not (held := stream.read(CHUNK)):
                raise Damaged(f"the member at {position} is cut off")
            try:
                got += unpack.decompress(held)
            except zlib.error as e:
                raise Damaged(f"the member at {position}: {e}") from e
            used += len(held) - len(unpack.unused_data)
            held = unpack.unused_data
            if head_end < 0 and (head_end := got.find(b"\r\n\r\n")) >= 0:
                lines = bytes(got[:head_end]).split(b"\r\n")
                if not lines[0].startswith(b"WARC/1."):
                    raise Damaged(f"the member at {position} is no WARC record")
                headers = _headers(lines[1:])
                length = int(headers["content-length"])
            if head_end >= 0 and len(got) > head_end + 4 + length + 4:
                raise Damaged(f"the record at {position} is longer than its Content-Length")
        if head_end < 0 or len(got) != head_end + 8 + length or got[-4:] != b"\r\n\r\n":
            raise Damaged(f"the record at {position} has {len(got) - head_end - 8} bytes for a Content-Length of {length}")
        yield Record(position, headers, bytes(got[head_end + 4 : -4]))
        position += used


def _name(urn: str | None) -> str | None:
    return urn.removeprefix("<urn:page:").removesuffix(">") if urn else None


def fields(r: Record) -> tuple:
    """What COLUMNS has of a record after its path.

    A response's length and digest are those of the body that was read, and a
    revisit's, whose body stands elsewhere, those that it declares. digest_ok:
    the block has its declared digest, and so have a response's body and length.
    """
    head, body = r.http()
    says, length = r.headers["warc-payload-digest"], int(head["content-length"])
    ok = digest(r.block) == r.headers["warc-block-digest"]
    if not (revisit := r.headers["warc-type"] == "revisit"):
        ok &= digest(body) == says and len(body) == length
        says, length = digest(body), len(body)
    full = base64.b32decode(says.removeprefix("sha1:")).hex()
    return (r.position, _name(r.headers["warc-record-id"]), r.headers["warc-type"], r.headers.get("warc-target-uri"), _name(r.headers.get("warc-refers-to")), None if revisit else body, length, full, ok)


def reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the archives whose paths come in."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.int64(), pa.string(), pa.bool_()]
    for batch in batches:
        for path in batch.column("path").to_pylist():
            files, at = opened(path)
            rows: list[tuple] = []
            size = 0
            with files.open_input_stream(at, compression=None) as stream:
                for r in read(stream):
                    rows.append((path, *fields(r)))
                    size += len(rows[-1][6] or b"")
                    if size > 1 << 22 or len(rows) >= 1000:
                        yield _rows(rows, kinds, names)
                        rows, size = [], 0
            yield _rows(rows, kinds, names)


def _rows(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write a record for each page below ``folder``; returns the archives' paths and numbers of records.

    The payload is the html in UTF-8, null an empty one. Of pages with equal
    payloads of at least ``least`` bytes that of the largest id is the response and
    the others are revisits of it; shorter ones are responses all. A page whose id
    is null has the record id "None" and takes no part in revisits; repeated rows
    of one id and payload are responses or revisits alike. Without pages there is
    no archive. Other columns play no part, whatever their names. Equality is
    SHA-256's over narrow rows, where payloads that very many pages have are spread
    over salts; html is shuffled once, by id.
    """
    bounded_batches(pages.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit(""))
    narrow = pages.select(F.col(id_col).alias("id"), F.sha2(payload, 256).alias("same"), F.octet_length(payload).alias("size")).filter((F.col("size") >= least) & F.col("id").isNotNull())
    last = saved(narrow.groupBy("same").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1"), "payloads")
    again = hot_join(narrow, last, ["same"], "n", ["id"]).filter("id <> refers_to").select("id", "same", "refers_to").distinct()
    full = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("html"))
    joined = full.join(again.withColumnRenamed("id", "rid"), (F.col("id") == F.col("rid")) & (F.sha2("html", 256) == F.col("same")), "left")
    rows = joined.select(F.col("id").cast("string").alias("id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))
    return rows.mapInArrow(writer(folder), "path string, records long")


def read_archives(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """All records of the archives that the column ``path`` names; see COLUMNS.

    payload is null for revisits; payload_bytes and payload_digest (hex SHA-1) are
    the full payload's; digest_ok says whether the stored digests hold. paths
    should be a written table: it is counted first, so that each archive has a
    task of its own (a given number of partitions isn't coalesced). No paths give
    no rows; a path that is named twice is read twice.
    """
    bounded_batches(spark)
    return paths.select("path").repartitionByRange(max(1, paths.count()), "path").mapInArrow(reader, COLUMNS)


def checked(records: DataFrame) -> DataFrame:
    """The records; one whose digests don't hold ends the job with its path and position."""
    where = F.concat(F.lit("the record at "), F.col("position"), F.lit(" of "), F.col("path"), F.lit(" isn't what its digests say"))
    return records.withColumn("record_id", F.when(F.col("digest_ok"), F.col("record_id")).otherwise(F.raise_error(where)))
