"""Where equal windows of a corpus meet: minimiser segments.

A window is ``length`` consecutive symbols (words or bytes) of one document.
Its anchor is the run of ``k`` symbols with the least hash in it, the first of
equals, so equal windows have equal anchors at the same place in them. The
windows of one anchor occurrence start one after the other; together they are a
segment. Windows can only be equal if their segments have the same anchor, so
the corpus is dealt out by anchor once, one row for each segment and not for
each window, and anchors that stand once are done.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .packed import U64, mix, prefix_sums, rolling, span_hashes

#: Symbols handled at once; a longer document is cut into overlapping blocks.
BLOCK = 1 << 20
LOW = U64(0xFFFFFFFF)


@dataclass
class Segments:
    """doc, first window start and number of windows (in symbols of the document), hashes of anchor and segment."""

    doc: np.ndarray
    lo: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    body: np.ndarray


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values."""
    n = len(x)
    if width == 1:
        return x
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, U64)
    padded[:n] = x
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(values: np.ndarray, bounds: np.ndarray, length: int, k: int, grams: Callable[[int, int], np.ndarray] | None = None) -> Segments:
    """Segments of all documents; values are symbol hashes, bounds the documents' borders in them.

    grams gives hashes of the k-symbol runs that begin and end in a range; by
    default they are computed from the values.
    """
    parts = []
    reach = max(BLOCK, 2 * length)
    n = len(values)
    for at in range(0, max(n - length + 1, 0), reach):
        to = min(at + reach + length - 1, n)
        parts.append(_block(values[at:to], grams(at, to) if grams else rolling(values[at:to], k), at, bounds, length, k))
    if not parts:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none.astype(U64), none.astype(U64))
    return Segments(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("doc", "lo", "count", "anchor", "body")))


def _block(values: np.ndarray, grams: np.ndarray, at: int, bounds: np.ndarray, length: int, k: int) -> Segments:
    least = sliding_least((grams & ~LOW) | np.arange(len(grams), dtype=U64), length - k + 1)
    n = len(least)
    new = np.ones(n + 1, bool)
    np.not_equal(least[1:], least[:-1], out=new[1:n])
    for border in (bounds, bounds - length + 1):  # a document's first window, and the first that doesn't fit
        border = border - at
        new[border[(border > 0) & (border < n)]] = True
    first = np.flatnonzero(new)
    lo, count = first[:-1] + at, np.diff(first)
    doc = np.searchsorted(bounds, lo, "right") - 1
    fits = lo + length <= bounds[doc + 1]
    doc, lo, count = doc[fits], lo[fits], count[fits]
    place = (least[lo - at] & LOW).astype(np.int64)
    sums, down = prefix_sums(values)
    body = span_hashes(sums, down, lo - at, lo - at + count + length - 1, 9)
    # where the anchor stands in the segment belongs to its identity
    return Segments(doc, lo - bounds[doc], count, grams[place], mix(body ^ mix((place - lo + at).astype(U64), 4), 3))
