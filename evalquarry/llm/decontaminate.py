"""Benchmark decontamination by a broadcast hash set of normalised n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packed import ALNUM, U64, Words, covered, pieces, prefix_sums, ranges, signed, span_hashes, take, words
from .shared import bounded_batches, hot_join, packed_rest, saved, schema_of, unpacked_rest

WINDOW = 10
#: The benchmark's windows are broadcast if they have at most so many bytes (words, hash and item of each); more are joined.
BROADCAST_BYTES = 64 << 20
#: Bits of the filter that a document's windows pass before a join, as a power of two: 16 MB.
FILTER_BITS = 27

NEW = ("n_words", "n_hit", "spans", "items", "clean_text", "contaminated")
#: hash, words of the window, item, and the window's normalised text for the check of hits
GRAMS = "gram long, width int, item {item}, words string"


def item_grams(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The windows of benchmark items: ``window`` words each, or all words of a shorter item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                w = words(piece, ALNUM, lower=True)
                n = np.diff(w.bounds)
                width = np.minimum(n, window)
                count = np.where(n, n - width + 1, 0)
                row = np.repeat(np.arange(len(n)), count)
                at = ranges(w.bounds[:-1], count)
                sums, down = prefix_sums(w.hashes)
                raw = piece.data.tobytes()
                texts = [normal(raw, w, a, b) for a, b in zip(at.tolist(), (at + width[row]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [signed(span_hashes(sums, down, at, at + width[row])), pa.array(width[row].astype(np.int32)), batch.column("item").take(pa.array(row + piece.first)), pa.array(texts, pa.string())],
                    names=["gram", "width", "item", "words"],
                )

    return run


def normal(raw: bytes, w: Words, a: int, b: int) -> str:
    """Words a..b, lower-cased and joined by one space."""
    return b" ".join([raw[x:y].lower() for x, y in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]).decode()


@dataclass
class Grams:
    """The benchmark's windows in order of width and hash: no object for each, one buffer for all words.

    Window i has the words text[at[i]:at[i + 1]] and the item items[item[i]]; those
    of width w are hashes[widths[w][0]:widths[w][1]].
    """

    hashes: np.ndarray
    widths: dict[int, tuple[int, int]]
    at: np.ndarray
    text: bytes
    item: np.ndarray
    items: list[str]

    def of(self, width: int, gram: np.uint64, words: bytes) -> list[str]:
        """Items that have this very window."""
        lo, hi = self.widths[width]
        a, b = (lo + int(np.searchsorted(self.hashes[lo:hi], gram, side)) for side in ("left", "right"))
        return [self.items[self.item[i]] for i in range(a, b) if self.text[self.at[i] : self.at[i + 1]] == words]


def gathered(grams: DataFrame) -> Grams:
    """The table of windows as arrays. Its size is checked before."""
    table = grams.toArrow().combine_chunks()
    hashes, width = np.asarray(table["gram"]).view(U64), np.asarray(table["width"])
    order = np.lexsort((hashes, width))
    words_ = table["words"].combine_chunks().cast(pa.large_string()).take(pa.array(order))
    item = table["item"].combine_chunks().dictionary_encode()
    at = np.frombuffer(words_.buffers()[1], np.int64)[words_.offset : words_.offset + len(words_) + 1] if len(words_) else np.zeros(1, np.int64)
    text = words_.buffers()[2].to_pybytes() if len(words_) else b""
    kinds, first = np.unique(width[order], return_index=True)
    ends = np.append(first[1:], len(order))[: len(first)].tolist()
    return Grams(hashes[order], {int(k): (int(a), b) for k, a, b in zip(kinds, first, ends, strict=True)}, at, text, np.asarray(item.indices)[order], item.dictionary.to_pylist())


def places(w: Words, width: int) -> np.ndarray:
    """Starts of the windows of ``width`` words that lie in one document."""
    at = np.arange(max(len(w.start) - width + 1, 0))
    return at[at + width <= w.bounds[w.doc[at] + 1]]


def scan(held: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents' hit spans (in words) and the items that are hit, by probing the windows of each width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: Grams = held.value
        for batch in batches:
            for piece in pieces(batch.column("text")):
                w = words(piece, ALNUM, lower=True)
                n = np.diff(w.bounds)
                sums, down = prefix_sums(w.hashes)
                raw, spans = None, [[] for _ in n]
                hit: list[set] = [set() for _ in n]
                for width, (lo, hi) in grams.widths.items():
                    at, wanted = places(w, width), grams.hashes[lo:hi]
                    found = span_hashes(sums, down, at, at + width)
                    i = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                    for j in np.flatnonzero(wanted[i] == found).tolist():
                        a = int(at[j])
                        raw = piece.data.tobytes() if raw is None else raw
                        if names := grams.of(width, found[j], normal(raw, w, a, a + width).encode()):
                            d = int(w.doc[a])
                            spans[d].append((a - int(w.bounds[d]), a - int(w.bounds[d]) + width))
                            hit[d].update(names)
                n_hit = [int(covered(*np.array(s).T, int(m)).sum()) if s else 0 for s, m in zip(spans, n, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*take(batch, ["id", "text", "rest"], piece.rows), pa.array(n), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(h) for h in hit], pa.list_(pa.string()))],
                    names=["id", "text", "rest", "n_words", "n_hit", "spans", "items"],
                )

    return run


def _cut(text: str | None, spans: list[list[int]]) -> str | None:
    """text without the words of the spans and what stands between them."""
    raw = (text or "").encode()
    w = words(next(pieces(pa.array([text or ""]))), ALNUM, lower=True)
    gone = covered(*np.array(spans).T, len(w.start))
    out, at, i = [], 0, 0
    while i < len(gone):
        j = i
        while j < len(gone) and gone[j]:
            j += 1
        if j > i:
            out.append(raw[at : w.start[i]])
            at = int(w.end[j - 1])
        i = max(j, i + 1)
    return b"".join([*out, raw[at:]]).decode()


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = np.asarray(batch.column("spans").value_lengths())
        clean = batch.column("text").to_pylist() if lengths.any() else batch.column("text")
        for r in np.flatnonzero(lengths).tolist():
            clean[r] = _cut(clean[r], batch.column("spans")[r].as_py())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clean, pa.string()) if isinstance(clean, list) else clean], names=[*batch.schema.names, "clean_text"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each document with the words that benchmark windows hit, and its text without them.

    A-Z are lower-cased; words are runs of 0-9, a-z and non-ASCII characters. A
    window is ``window`` consecutive words of an item, all words of a shorter one.
    Returns docs with n_words, n_hit, spans (word ranges of hits), items (ids
    of items with hits, as strings in order), clean_text and contaminated. Null
    and empty texts have no words and no hits; a null item id counts as the item
    "null"; repeated documents each get their row; repeated items count once.
    Other columns pass through, but for those named like new ones. An empty benchmark hits nothing.

    The benchmark's windows are broadcast if they have at most ``broadcast_bytes``;
    otherwise the documents' windows that pass a filter of fixed size meet them in
    a join on hash and words that spreads windows which very many documents have.
    """
    spark = docs.sparkSession
    bounded_batches(docs.sparkSession)
    own = (id_col, text_col, *NEW)
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), packed_rest(docs, *own))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    grams = items.mapInArrow(item_grams(window), GRAMS.format(item="string")).distinct()
    columns = schema_of(keyed, ["id", "text", "rest"], "n_words long, n_hit long, spans array<array<long>>, items array<string>")
    grams = saved(grams, "grams")
    size = grams.agg(F.coalesce(F.sum(F.octet_length("words") + F.octet_length("item") + 32), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        out = keyed.mapInArrow(scan(spark.sparkContext.broadcast(gathered(grams))), columns)
    else:
        out = _joined(keyed, grams, window, columns)
    out = out.mapInArrow(_clean, schema_of(out, out.columns, "clean_text string"))
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *unpacked_rest(docs, *own), *NEW[:-1], (F.col("n_hit") > 0).alias("contaminated"))


def bitmap(grams: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits that have those of all windows' hashes set: its size doesn't follow the benchmark's."""
    word = F.shiftrightunsigned("gram", 64 - FILTER_BITS + 6)
    table = grams.groupBy(word.cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - FILTER_BITS}) & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), U64)
    out[np.asarray(table["word"])] = np.asarray(table["bits"]).view(U64)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> U64(64 - FILTER_BITS)
    return (bits[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) == 1


def _joined(keyed: DataFrame, grams: DataFrame, window: int, columns: T.StructType) -> DataFrame:
    """The same for a benchmark too large to broadcast: windows of documents join those of items."""
    widths = sorted(r[0] for r in grams.select("width").distinct().collect())  # at most ``window`` numbers
    kind = keyed.schema["id"].dataType.simpleString()
    numbered = keyed.withColumn("h", F.xxhash64("text"))
    held = keyed.sparkSession.sparkContext.broadcast(bitmap(grams))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                w = words(piece, ALNUM, lower=True)
                sums, down = prefix_sums(w.hashes)
                raw = None
                for width in widths:
                    at = places(w, width)
                    found = span_hashes(sums, down, at, at + width)
                    good = passes(held.value, found)
                    at, found = at[good], found[good]
                    if not len(at):
                        continue
                    raw = piece.data.tobytes() if raw is None else raw
                    rows = pa.array(w.doc[at] + piece.first)
                    texts = [normal(raw, w, a, a + width) for a in at.tolist()]
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("h").take(rows), signed(found), pa.array(at - w.bounds[w.doc[at]]), pa.array(np.full(len(at), width, np.int32)), pa.array(texts, pa.string())], names=["id", "h", "gram", "lo", "width", "words"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                n = np.diff(words(piece, ALNUM, lower=True).bounds)
                spans = batch.column("spans").slice(piece.rows.start, len(n)).to_pylist()
                n_hit = [int(covered(*np.array(s).T, int(m)).sum()) if s else 0 for s, m in zip(spans, n, strict=True)]
                yield pa.RecordBatch.from_arrays([*take(batch, ["id", "text", "rest"], piece.rows), pa.array(n), pa.array(n_hit, pa.int64()), *take(batch, ["spans", "items"], piece.rows)], names=["id", "text", "rest", "n_words", "n_hit", "spans", "items"])

    same = ["gram", "width", "words"]
    near = saved(numbered.select("id", "h", "text").mapInArrow(candidates, f"id {kind}, h long, gram long, lo long, width int, words string"), "candidates")
    often = near.groupBy(*same).agg(F.count("*").alias("c"))
    named = saved(grams.groupBy(*same).agg(F.collect_set("item").alias("items")).join(often, same), "hits")
    met = hot_join(near, named, same, "c", ["id", "lo"])
    hits = met.groupBy(F.col("id").alias("wid"), F.col("h").alias("wh")).agg(
        F.sort_array(F.collect_set(F.array("lo", F.col("lo") + F.col("width")))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    joined = numbered.join(hits, F.col("id").eqNullSafe(F.col("wid")) & (F.col("h") == F.col("wh")), "left")
    none = F.array().cast("array<array<long>>")
    return joined.select("id", "text", "rest", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).mapInArrow(count, columns)
