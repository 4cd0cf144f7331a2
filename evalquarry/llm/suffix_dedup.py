"""Suffix-array dedup: deep-shallow sorting of the suffixes that can repeat.

``repeats.py`` leaves, for each anchor, its different segments. Their suffixes
that begin a window are sorted to the window's length in two steps: multikey
quicksort on eight bytes at a time to a shallow depth, then a blind trie for
each group that still agrees there. Windows that share a trie leaf are equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import U64, covered, pieces, ranges, take
from .repeats import content_values, once, repeated_spans, shards, with_spans

LENGTH = 200
#: Bytes of an anchor, those of packed.byte_grams. Long enough that texts without a common passage rarely share one.
ANCHOR = 64
SHALLOW = 128
STEP = 8
SHARD_BYTES = 1_000_000


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(STEP, np.uint8)])
    out = np.zeros(len(data), U64)
    for i in range(STEP):
        out = (out << U64(8)) | padded[i : i + len(data)].astype(U64)
    return out


def multikey_quicksort(keys: np.ndarray, suffixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` bytes, and where each group of equals begins.

    All groups take a step at once: each splits into the suffixes whose next eight
    bytes are less than, equal to and more than its pivot's; the equal ones go on
    behind those bytes.
    """
    order = suffixes.copy()
    begin, reached = np.zeros(1, np.int64), np.zeros(1, np.int64)
    size = np.array([len(order)], np.int64)
    done: list[np.ndarray] = []
    while len(begin):
        open_ = (size > 1) & (reached < depth)
        done.append(begin[~open_])
        begin, size, reached = begin[open_], size[open_], reached[open_]
        if not len(begin):
            break
        at = ranges(begin, size)
        group = np.repeat(np.arange(len(begin)), size)
        key = keys[order[at] + reached[group]]
        three = np.stack([keys[order[begin + o] + reached] for o in (0 * size, size // 2, size - 1)])
        pivot = np.sort(three, axis=0)[1][group]
        part = group * 3 + (key >= pivot) + (key > pivot)
        order[at] = order[at][np.argsort(part, kind="stable")]
        sizes = np.bincount(part, minlength=3 * len(begin)).reshape(-1, 3)
        begins = begin[:, None] + np.cumsum(sizes, axis=1) - sizes
        after = np.repeat(reached, 3).reshape(-1, 3) + np.array([0, STEP, 0])
        full = sizes > 0
        begin, size, reached = begins[full], sizes[full], after[full]
    return order, np.sort(np.concatenate(done)) if len(order) else np.zeros(0, np.int64)


class BlindTrie:
    """A trie that keeps only branching depths: a search checks one leaf's bytes at its end."""

    __slots__ = ("root", "size")

    def __init__(self, size: int) -> None:
        self.root: list | None = None
        self.size = size

    def insert(self, text: bytes, name: int) -> None:
        """Leaves are [size, text, names]; inner nodes [depth, {byte: node}, a leaf below]."""
        size = self.size
        if self.root is None:
            self.root = [size, text, [name]]
            return
        node = self.root
        while node[0] < size:
            node = node[1].get(text[node[0]]) or node[2]
        if node[1] == text:
            node[2].append(name)
            return
        differ = int.from_bytes(node[1]) ^ int.from_bytes(text)
        depth = size - (differ.bit_length() + 7) // 8
        leaf = [size, text, [name]]
        up, node = None, self.root
        while node[0] < depth:
            up, node = node, node[1][text[node[0]]]
        if node[0] == depth and node[0] < size:
            node[1][text[depth]] = leaf
            return
        some = node if node[0] == size else node[2]
        inner = [depth, {some[1][depth]: node, text[depth]: leaf}, some]
        if up is None:
            self.root = inner
        else:
            up[1][text[up[0]]] = inner

    def leaves(self) -> Iterator[list[int]]:
        """Names of equal texts, in the texts' order."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] == self.size:
                yield node[2]
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))


def repeated_starts(data: np.ndarray, suffixes: np.ndarray, length: int, shallow: int = SHALLOW) -> np.ndarray:
    """Those suffixes whose first ``length`` bytes another one has too."""
    shallow = min(shallow, length // STEP * STEP)
    order, begin = multikey_quicksort(eights(data), suffixes, shallow)
    size = np.diff(np.append(begin, len(order)))
    raw = data.tobytes()
    out: list[int] = []
    for b, n in zip(begin[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        trie = BlindTrie(length - shallow)
        for s in order[b : b + n].tolist():
            trie.insert(raw[s + shallow : s + length], s)
        for names in trie.leaves():
            if len(names) > 1:
                out += names
    return np.array(out, np.int64)


def sort_suffixes(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans of windows that the shard holds more than once; rows of a reference (those that don't stream) are sorted with the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches, SHARD_BYTES):
            batch = once(table)
            data, bounds = content_values(batch.column("content"))
            found = np.sort(repeated_starts(data, ranges(bounds[:-1], np.diff(bounds) - length + 1), length))
            row = np.searchsorted(bounds, found, "right") - 1
            found, row = (x[np.asarray(batch.column("streams"))[row] == 1] for x in (found, row))
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1] + 1) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(found))[: len(first)] - 1
            rows = row[first]
            lo = np.asarray(batch.column("lo"))[rows] + found[first] - bounds[rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)), batch.column("h").take(pa.array(rows)), pa.array(lo), pa.array(lo + found[last] - found[first] + length)],
                names=["id", "h", "lo", "hi"],
            )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts' bytes without those in their spans."""
    for batch in batches:
        spans = batch.column("spans")
        for piece in pieces(batch.column("text")):
            part = spans.slice(piece.rows.start, len(piece.rows))
            held = part.flatten()
            doc = np.repeat(np.arange(len(part)), np.asarray(part.value_lengths().fill_null(0)))
            gone = covered(piece.bounds[doc] + np.asarray(held.field(0)), piece.bounds[doc] + np.asarray(held.field(1)), len(piece.data))
            sums = np.zeros(len(gone) + 1, np.int64)
            np.cumsum(gone, out=sums[1:])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            starts = piece.bounds[:-1]
            begins[starts[starts < len(gone)]] = gone[starts[starts < len(gone)]]
            runs = np.zeros(len(gone) + 1, np.int64)
            np.cumsum(begins, out=runs[1:])
            removed, spans_n = np.diff(sums[piece.bounds]), np.diff(runs[piece.bounds])
            kept = piece.data[~gone]
            ends = (piece.bounds - sums[piece.bounds]).astype(np.int64)
            content = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(kept))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*take(batch, ["id"], piece.rows), pa.array(np.diff(piece.bounds)), pa.array(removed), pa.array(spans_n), content], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Each document's bytes without those that a ``length``-byte string covers which starts anywhere else too.

    Texts are UTF-8 bytes, null and empty ones none; matches stay within a document,
    and strings are judged on the input. All occurrences go, the first included;
    every row is a document, so repeated rows remove one another. Returns id_col,
    n_bytes, n_removed, n_spans (maximal removed runs) and kept (the rest, binary:
    a cut may fall inside a character). Rows with equal id and text share their
    spans; a null id is an id like others. Other columns of docs play no part,
    whatever their names. An empty table stays empty.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    spans = repeated_spans(keyed, "bytes", length, anchor, False, sort_suffixes(length))
    kind = keyed.schema["id"].dataType.simpleString()
    out = with_spans(keyed, spans).mapInArrow(_cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)
