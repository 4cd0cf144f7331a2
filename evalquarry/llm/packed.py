"""Texts of an Arrow batch as flat numpy arrays: words, their hashes, rolling hashes.

A string column of an Arrow batch already is one byte buffer and an offsets
array, so tokenising and hashing need no Python object per document or word.
Every function takes whole texts; long batches are cut at document borders into
pieces of about ``PIECE`` bytes, so a task's memory follows the longest document
and not the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
U64 = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = np.asarray(x, U64) + U64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


#: A random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(256, dtype=U64), 77)
BASE = 0x5851F42D4C957F2D | 1


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base % 2**64, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, m, 2**64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inverse, m, 2**64))])
        return self.up, self.down


_POWERS: dict[int, Powers] = {}


def prefix_sums(values: np.ndarray, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values[i] * base**i, and base**-i; see span_hashes."""
    up, down = _POWERS.setdefault(base, Powers(base)).get(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def span_hashes(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each values[start:end], equal for equal sequences wherever they stand."""
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93), seed)


def scramble(x: np.ndarray) -> np.ndarray:
    """Cheaper than mix: good high bits, for choosing and not for keeping."""
    return (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)


def byte_grams(data: np.ndarray, doublings: int = 2) -> np.ndarray:
    """Hashes of all runs of 16 bytes, doubled: 64 for two doublings, straight from the bytes as numbers."""
    n = len(data) - 7
    if n < 1 or len(data) < 16 << doublings:
        return np.zeros(0, U64)
    out = np.ndarray((n,), np.dtype("<u8"), np.ascontiguousarray(data), strides=(1,)).astype(U64)
    for d in range(doublings + 1):
        reach = 8 << d
        out = scramble(scramble(out[:-reach] * U64(0x9E3779B97F4A7C15)) + out[reach:] * U64(0xC2B2AE3D27D4EB4F))
    return out


def rolling(values: np.ndarray, width: int, seed: int = 0, base: int = BASE) -> np.ndarray:
    """Hashes of all runs of ``width`` values."""
    if len(values) < width:
        return np.zeros(0, U64)
    sums, down = prefix_sums(values, base)
    n = len(values) - width + 1
    return mix((sums[width:] - sums[:n]) * down[:n], seed)


def byte_table(pattern_bytes: Iterator[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


#: Words are maximal runs of bytes other than space and \x09-\x0D.
SPACED = byte_table(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are maximal runs of 0-9, a-z and bytes of non-ASCII characters (after lower-casing A-Z).
ALNUM = byte_table(b for b in range(256) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Piece:
    """Some documents of a batch: their rows, bytes, and where each begins."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> range:
        return range(self.first, self.first + len(self.bounds) - 1)


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[Piece]:
    """The column's documents in pieces of about ``size`` bytes; null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, n)
        yield Piece(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """All words of a piece; doc counts from the piece's first document, bounds are in words."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray


def words(piece: Piece, table: np.ndarray = SPACED, lower: bool = False) -> Words:
    data = LOWER[piece.data] if lower else piece.data
    n, docs = len(data), len(piece.bounds) - 1
    inside = table[data]
    cut = np.zeros(n + 1, bool)
    cut[piece.bounds] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    bounds = np.searchsorted(start, piece.bounds)
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    sums, down = prefix_sums(BYTE_VALUES[data])
    return Words(start, end, doc, bounds, span_hashes(sums, down, start, end))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths) or not lengths.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) - np.repeat(ends - lengths - starts, lengths)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(starts, 0, n), 1)
    np.add.at(edge, np.clip(ends, 0, n), -1)
    return np.cumsum(edge[:n]) > 0


def take(batch: pa.RecordBatch, names: list[str], rows: range) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)).slice(rows.start, len(rows)) for n in names]


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as a long column."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose i-th row has the next counts[i] values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
