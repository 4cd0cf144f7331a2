"""Files of any size, read in pieces inside tasks: arrays by spans of their rows, hashes and counts of lines piece by piece.

Spark lists the files and deals them out; no row ever holds a whole file.
"""

from __future__ import annotations

import hashlib
import os
import zipfile
from collections import namedtuple
from collections.abc import Iterator
from io import BytesIO
from typing import BinaryIO
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stable import spread

#: Bytes of an array that one task reads as one span, and of any file that a task holds at a time.
SPAN, PIECE = 64 << 20, 4 << 20


def opened(path: str, content: bytes | None = None) -> BinaryIO:
    """A file by the name that Spark gives it, or its content if that is there, for reading at any place."""
    if content is not None:
        return BytesIO(content)
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        where = (rest if colon else path).removeprefix("//")
        return fs.LocalFileSystem().open_input_file(os.path.abspath(where))
    files, name = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{quote(rest)}")
    return files.open_input_file(name)


def listed(spark: SparkSession, path: str, recursive: bool = False) -> tuple[DataFrame, bool]:
    """path and content of files, empty ones too, dealt over all tasks; and whether tasks can open them.

    content is null, as tasks open the files themselves, unless they lie in a store that only Spark
    reaches: there it has the whole file, of 2 GB at most. The names come from Spark's
    file index, which the driver holds for any scan; a scan itself leaves out empty files.
    """
    files = spark.read.format("binaryFile")
    found = (files.option("recursiveFileLookup", True) if recursive else files).load(path)
    names = [unquote(n).replace(":///", ":/", 1) for n in found.inputFiles()]  # as the column path has them
    paths = spread(spark.createDataFrame([(n,) for n in names], "path string"))
    if not names or _reached(names[0]):
        return paths.withColumn("content", F.lit(None).cast("binary")), True
    return paths.join(found.select("path", "content"), "path", "left").withColumn("content", F.coalesce("content", F.lit(b""))), False


def _reached(path: str) -> bool:
    """Whether Python can open a file of Spark's by its name."""
    try:
        opened(path).close()
    except (OSError, ValueError, NotImplementedError):  # no such file system for Arrow, or not its library
        return False
    return True


def manifest(spark: SparkSession, root: str, piece: int = PIECE) -> DataFrame:
    """path, size, sha256 and, for .jsonl files, records (lines that aren't blank) of every file below a folder.

    A hash runs through a file in order, so a file is one task's, which holds ``piece`` bytes of it at a time.
    """

    def digested(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                with opened(path, content) as f:
                    yield pd.DataFrame([(path, *digest_and_records(f, piece, path.endswith(".jsonl")))], columns=["path", "size", "sha256", "records"]).astype({"records": "Int64"})

    files, _ = listed(spark, root, recursive=True)
    return files.mapInPandas(digested, "path string, size long, sha256 string, records long")


def digest_and_records(f: BinaryIO, piece: int, lines: bool) -> tuple[int, str, int | None]:
    """Size, SHA-256 and (if asked for) the number of lines with anything but white space; a line may run over pieces."""
    sha, size, records, told = hashlib.sha256(), 0, 0, False  # told: the line at hand has been counted
    while block := f.read(piece):
        sha.update(block)
        size += len(block)
        if lines:
            first, *others = block.split(b"\n")
            records += not told and bool(first.strip())
            told = told or bool(first.strip())
            if others:
                records += sum(1 for line in others if line.strip())
                told = bool(others[-1].strip())
    return size, sha.hexdigest(), records if lines else None


def arrays(spark: SparkSession, glob: str, span: int = SPAN) -> DataFrame:
    """Rows of the arrays in .npy and .npz files: path, name (of an archive's array, else null), row, values.

    Two steps: each file's headers give its arrays' shapes and from them spans of rows of
    about ``span`` bytes; the spans are dealt over all tasks, and each is read from its
    own place in the file. A number or a vector is one row; an array without rows gives none.
    A compressed array of an archive can't be entered in the middle: it is one task's,
    which holds a span of it at a time. Arrays of more than two dimensions or of anything but real
    numbers are an error, and so are compressed ones in column order with more than a span.
    """

    def headers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                with opened(path) as f:
                    yield pd.DataFrame([(path, *s) for s in spans_of(f, path, span)], columns=list(SPANS)).astype({"at": "Int64"})

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for s in part.itertuples(index=False):
                with opened(s.path) as f:
                    yield from rows_of(f, Span(*s), span)

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                for s in spans_of(BytesIO(content), path, span):
                    yield from rows_of(BytesIO(content), Span(path, *s), span)

    schema = "path string, name string, row long, values array<double>"
    files, reached = listed(spark, glob)
    if not reached:
        return files.mapInPandas(whole, schema)
    return spread(files.select("path").mapInPandas(headers, ", ".join(f"{n} {t}" for n, t in SPANS.items()))).mapInPandas(rows, schema)


#: A span: rows ``first`` up to ``first + n`` of ``rows``, of an array whose numbers begin at byte ``at`` (null: compressed).
SPANS = {"path": "string", "name": "string", "member": "string", "at": "long", "dtype": "string", "by_column": "boolean", "rows": "long", "width": "long", "first": "long", "n": "long"}

Span = namedtuple("Span", SPANS)


def rows_of(f: BinaryIO, s: Span, span: int) -> Iterator[pd.DataFrame]:
    """A span's rows as tables of at most about PIECE bytes."""
    first = int(s.first)
    for block in blocks_of(f, s, span):
        step = max(1, PIECE // max(1, 8 * block.shape[1]))
        for i in range(0, len(block), step):
            values = block[i : i + step].astype(float)
            yield pd.DataFrame({"path": s.path, "name": s.name, "row": range(first + i, first + i + len(values)), "values": list(values)})
        first += len(block)


def spans_of(f: BinaryIO, path: str, span: int) -> Iterator[tuple]:
    """The spans of all arrays of a file, without its path."""
    if f.read(4) != b"PK\x03\x04":
        f.seek(0)
        yield from _cut(None, None, f, path, span, True)
        return
    f.seek(0)
    with zipfile.ZipFile(f) as archive:
        for info in archive.infolist():
            with archive.open(info) as inner:
                stored = info.compress_type == zipfile.ZIP_STORED
                yield from _cut(info.filename.removesuffix(".npy"), info.filename, inner, path, span, stored, _begin(f, info) if stored else 0)


def _begin(f: BinaryIO, info: zipfile.ZipInfo) -> int:
    """Where a member's bytes begin: after its local header, whose name and extra field have their own lengths."""
    back = f.tell()
    f.seek(info.header_offset + 26)
    lengths = np.frombuffer(f.read(4), "<u2")
    f.seek(back)
    return info.header_offset + 30 + int(lengths.sum())


def _cut(name: str | None, member: str | None, f: BinaryIO, path: str, span: int, direct: bool, begin: int = 0) -> Iterator[tuple]:
    shape, by_column, dtype = _header(f)
    at = begin + f.tell()
    if len(shape) > 2 or dtype.kind not in "biuf":
        raise ValueError(f"{path}: {name or 'the array'} is no table of real numbers: {dtype}, {shape}")
    rows, width = shape if len(shape) == 2 else (1, int(np.prod(shape, dtype=int)))
    each = max(1, span // max(1, width * dtype.itemsize)) if direct else max(rows, 1)
    if by_column and min(rows, width) > 1 and not direct and rows * width * dtype.itemsize > span:
        raise ValueError(f"{path}: {name} is compressed and in column order, and longer than a span")
    for first in range(0, rows, each):
        yield name, member, at if direct else None, dtype.str, by_column and min(rows, width) > 1, rows, width, first, min(each, rows - first)


def _header(f: BinaryIO) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(f)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)


def blocks_of(f: BinaryIO, s: Span, span: int) -> Iterator[np.ndarray]:
    """A span's rows, as tables of at most about ``span`` bytes."""
    dtype, width, n = np.dtype(s.dtype), int(s.width), int(s.n)
    size = dtype.itemsize

    def exactly(source: BinaryIO, count: int) -> bytes:
        parts, left = [], count
        while left and (got := source.read(left)):
            parts.append(got)
            left -= len(got)
        if left:
            raise ValueError(f"{s.path}: the array ends {left} bytes early")
        return b"".join(parts)

    if pd.isna(s.at):
        with zipfile.ZipFile(f) as archive, archive.open(s.member) as inner:
            _header(inner)
            if s.by_column:
                yield np.frombuffer(exactly(inner, n * width * size), dtype).reshape(width, n).T
                return
            step = max(1, span // max(1, width * size))
            for i in range(0, n, step):
                k = min(step, n - i)
                yield np.frombuffer(exactly(inner, k * width * size), dtype).reshape(k, width)
    elif s.by_column:
        out = np.empty((n, width), dtype)
        for j in range(width):
            f.seek(int(s.at) + (j * int(s.rows) + int(s.first)) * size)
            out[:, j] = np.frombuffer(exactly(f, n * size), dtype)
        yield out
    else:
        f.seek(int(s.at) + int(s.first) * width * size)
        yield np.frombuffer(exactly(f, n * width * size), dtype).reshape(n, width)
