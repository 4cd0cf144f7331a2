"""Repeated windows of a corpus: the Spark job that substring and suffix-array dedup share.

1. Every document's minimiser segments (``segments.py``) are dealt by anchor;
   anchors that stand once are dropped after a map-side count.
2. Segments that are equal as a whole are collapsed by an aggregation: this
   resolves exact copies, however many, without gathering them.
3. Different segments of one anchor are compared symbol by symbol in shards:
   substring dedup streams them through a suffix automaton, suffix-array dedup
   sorts their suffixes. A shard is a run of whole anchors of bounded size.
4. An anchor with more different segments than ``HOT`` (the rims of a passage
   that very many documents share) fits no shard as a whole. A count of window
   hashes with map-side combine says which of its windows repeat at all; runs of
   those, where they stand first, are the anchor's reference shard. It is sent to
   as many salts as the anchor needs, and its segments are dealt out over them
   and streamed through the reference's automaton, or sorted with its suffixes.
5. Only an anchor whose own reference has more windows than ``REFERENCE`` (it
   repeats in that many different contexts) takes the spans that the counted
   hashes give: two independent ones of 64 bits for each window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import BYTE_VALUES, SPACED, U64, Piece, byte_grams, lists, mix, pieces, ranges, rolling, signed, words
from .segments import segments
from .shared import bounded_batches, hot_join, saved

#: An anchor with more different segments than this is dealt out over salts, so many segments to each.
HOT = 2000
#: Windows of an anchor's reference shard, at most.
REFERENCE = 50_000
#: A shard ends at the first anchor after so many symbols.
SHARD = 60_000

#: Symbols compared in one task, or so.
TASK = 2_000_000

KEY = "id {id}, h long"


def keyed_partitions(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.shuffle.partitions")


def symbols(piece: Piece, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbol hashes of a piece and the documents' borders in them."""
    if unit == "words":
        w = words(piece, SPACED)
        return w.hashes, w.bounds
    return BYTE_VALUES[piece.data], piece.bounds


def segment_rows(unit: str, length: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text")):
                values, bounds = symbols(piece, unit)
                s = segments(values, bounds, length, k, (lambda a, b, d=piece.data: byte_grams(d[a:b])) if unit == "bytes" else None)
                rows = pa.array(s.doc + piece.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(rows), batch.column("h").take(rows), pa.array(s.lo), pa.array(s.count.astype(np.int32)), signed(s.anchor), signed(s.body)],
                    names=["id", "h", "lo", "n", "anchor", "body"],
                )

    return run


def content_rows(unit: str, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The symbols of the segments that a document's row lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            flat, offsets = wanted.flatten(), np.asarray(wanted.offsets)
            lo, n, anchor, salts = (flat.field(i) for i in range(4))
            for piece in pieces(batch.column("text")):
                values, bounds = symbols(piece, unit)
                rows = np.arange(piece.rows.start, piece.rows.stop)
                a, b = offsets[rows[0]] - offsets[0], offsets[rows[-1] + 1] - offsets[0]
                doc = np.repeat(rows, np.diff(offsets[rows[0] : rows[-1] + 2]))
                size = np.asarray(n)[a:b].astype(np.int64) + length - 1
                begin = bounds[doc - rows[0]] + np.asarray(lo)[a:b]
                got = (values if unit == "words" else piece.data)[ranges(begin, size)]
                kept = [anchor.slice(a, b - a), salts.slice(a, b - a), *(batch.column(c).take(pa.array(doc)) for c in ("id", "h")), lo.slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([*kept, content_column(got, size)], names=["anchor", "salts", "id", "h", "lo", "content"])

    return run


def content_column(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """Rows of the next size[i] symbols: words as lists of their hashes, bytes as they are."""
    if values.dtype == U64:
        return lists(values.view(np.int64), size, pa.int64())
    ends = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def content_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat symbols of a content column and the rows' borders in them."""
    if pa.types.is_list(column.type):
        offsets = np.asarray(column.offsets).astype(np.int64)
        return np.asarray(column.flatten()).view(U64), offsets - offsets[0]
    piece = list(pieces(column, 1 << 62))[0]
    return piece.data, piece.bounds


def window_rows(length: int, counted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Two independent hashes of each window of the segments, and how many rows a row stands for.

    counted: of a batch's equal windows only the first and the last place are
    given, with the others' number: counts combine before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if counted:
                batch = batch.take(pc.sort_indices(batch, sort_keys=[(c, "ascending") for c in ("id", "h", "lo")], null_placement="at_start"))
            values, bounds = content_values(batch.column("content"))
            values = BYTE_VALUES[values] if values.dtype == np.uint8 else values
            count = np.diff(bounds) - length + 1
            start = ranges(bounds[:-1], count)
            one, two = rolling(values, length, 21)[start], rolling(mix(values, 8), length, 22)[start]
            weight, kept = np.ones(len(start), np.int64), np.arange(len(start))
            if counted and len(start):
                order = np.lexsort((two, one))  # stable: equal windows stay in the order of places
                new = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(order)) - 1
                kept = np.append(order[head], order[tail[tail > head]])
                weight = np.append(np.where(tail > head, tail - head, 1), np.ones(int((tail > head).sum()), np.int64))
            owner = np.repeat(np.arange(len(batch)), count)[kept]
            lo = np.asarray(batch.column("lo"))[owner] + start[kept] - bounds[owner]
            same = [batch.column(c).take(pa.array(owner)) for c in ("anchor", "id", "h", "lo")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(lo), signed(one[kept]), signed(two[kept]), pa.array(weight)], names=["anchor", "id", "h", "segment", "lo", "one", "two", "weight"])

    return run


def reference_rows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each segment the runs of those windows whose starts (in symbols of the document) ``starts`` lists, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bounds = content_values(batch.column("content"))
            starts = batch.column("starts")
            row = np.repeat(np.arange(len(batch)), np.asarray(starts.value_lengths()))
            at = np.asarray(starts.flatten())
            first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]))) if len(at) else at
            last = np.append(first[1:], len(at))[: len(first)] - 1
            size, owner = at[last] - at[first] + length, row[first]
            got = values[ranges(bounds[owner] + at[first] - np.asarray(batch.column("lo"))[owner], size)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(owner)) for c in ("anchor", "salts", "id", "h")), pa.array(at[first]), content_column(got, size)], names=["anchor", "salts", "id", "h", "lo", "content"])

    return run


def borders(batch: pa.RecordBatch) -> np.ndarray:
    """Ends of the runs of one anchor and salt."""
    anchor, salt = (np.asarray(batch.column(c)) for c in ("anchor", "salt"))
    return np.append(np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1, len(batch))


def shards(batches: Iterator[pa.RecordBatch], size: int = SHARD) -> Iterator[pa.Table]:
    """Runs of whole anchors (or of an anchor's salts) from rows sorted by them, each of about ``size`` symbols."""
    held: list[pa.RecordBatch] = []
    symbols_held = 0
    ends = lambda batch, row: tuple(batch.column(c)[row].as_py() for c in ("anchor", "salt"))
    for batch in batches:
        if not len(batch):
            continue
        _, bounds = content_values(batch.column("content"))
        at, goes_on = 0, bool(held) and ends(held[-1], -1) == ends(batch, 0)
        for to in borders(batch):
            if symbols_held >= size and (at > 0 or not goes_on):  # a batch may begin inside the anchor that is held
                yield pa.Table.from_batches(held)
                held, symbols_held = [], 0
            held.append(batch.slice(at, to - at))
            symbols_held += int(bounds[to] - bounds[at])
            at = to
    if held:
        yield pa.Table.from_batches(held)


def once(table: pa.Table) -> pa.RecordBatch:
    """The shard as one batch without repeated rows; rows are sorted."""
    batch = table.combine_chunks().to_batches()[0]
    same = np.ones(len(batch), bool)
    same[0] = False
    for c in ("anchor", "salt", "streams", "id", "h", "lo"):
        col = batch.column(c).fill_null(-(2**63)) if batch.column(c).null_count else batch.column(c)
        if pa.types.is_integer(col.type):
            v = np.asarray(col)
            same[1:] &= v[1:] == v[:-1]
        else:
            v = col.to_pylist()
            same[1:] &= np.array([x == y for x, y in zip(v[1:], v[:-1], strict=True)], bool)
    return batch.filter(pa.array(~same))


def repeated_spans(docs: DataFrame, unit: str, length: int, k: int, later_only: bool, compare: Callable) -> DataFrame:
    """Spans (id, h, lo, hi) of symbols that repeated windows cover.

    docs: id, h, text, where h tells apart texts that have one id. later_only:
    the first of equal windows (by id, then h, then place) isn't reported.
    compare: mapInArrow function from sorted content rows to spans.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["id"].dataType.simpleString()
    key = KEY.format(id=kind)
    found = docs.mapInArrow(segment_rows(unit, length, k), f"{key}, lo long, n int, anchor long, body long")
    often = saved(found.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1"), "anchors")
    seen = saved(hot_join(found, often, ["anchor"], "c", ["id", "lo"]), "segments")

    place = F.struct("id", "h", "lo")
    distinct = seen.groupBy("anchor", "body").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.count("*").alias("copies"))
    copied = saved(distinct.filter("copies > 1").select("anchor", "body", "first", "copies"), "copies")
    spans = hot_join(seen, copied, ["anchor", "body"], "copies", ["id", "lo"])
    if later_only:
        spans = spans.filter(~place.eqNullSafe(F.col("first")))
    spans = spans.select("id", "h", "lo", (F.col("lo") + F.col("n") + (length - 1)).alias("hi"))

    differ = distinct.groupBy("anchor").agg(F.count("*").alias("d")).filter("d > 1").select("anchor", F.ceil(F.col("d") / HOT).cast("int").alias("salts"))
    edges = distinct.select("anchor", "first.*", "n").join(differ, "anchor")
    wanted = edges.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("lo", "n", "anchor", "salts"))).alias("wanted"))
    fetched = docs.join(wanted.withColumnsRenamed({"id": "wid", "h": "wh"}), F.col("id").eqNullSafe(F.col("wid")) & (F.col("h") == F.col("wh"))).select("id", "h", "text", "wanted")
    held = f"anchor long, salts int, {key}, lo long, content {'array<long>' if unit == 'words' else 'binary'}"
    content = saved(fetched.mapInArrow(content_rows(unit, length), held), "content")

    # hot anchors: which windows repeat, where each stands first, and how many such windows an anchor has
    spread = content.filter("salts > 1")
    columns = f"anchor long, {key}, segment long, lo long, one long, two long, weight long"
    windows = spread.mapInArrow(window_rows(length, True), columns)
    where = F.struct("id", "h", "lo", "anchor", "segment")
    least = windows.groupBy("one", "two").agg(F.min(where).alias("first"), F.max(where).alias("last"), F.sum("weight").alias("c")).filter(~F.col("first").eqNullSafe(F.col("last")))
    least = saved(least.select("one", "two", "first", "c"), "windows")
    wide = saved(least.groupBy(F.col("first.anchor").alias("anchor")).agg(F.count("*").alias("w")).filter(F.col("w") > REFERENCE).select("anchor"), "wide")
    narrow = least.select("first.*").join(wide, "anchor", "left_anti")
    starts = narrow.groupBy("anchor", F.col("id").alias("wid"), F.col("h").alias("wh"), "segment").agg(F.sort_array(F.collect_set("lo")).alias("starts"))
    at_start = (spread["anchor"] == starts["anchor"]) & F.col("id").eqNullSafe(F.col("wid")) & (F.col("h") == F.col("wh")) & (F.col("lo") == F.col("segment"))
    first_runs = spread.join(starts, at_start).select(spread["anchor"], "salts", "id", "h", "lo", "content", "starts").dropDuplicates(["anchor", "id", "h", "lo"])
    references = first_runs.mapInArrow(reference_rows(length), held).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    streams = content.join(wide, "anchor", "left_anti").withColumn("salt", F.pmod(F.xxhash64("id", "h", "lo"), F.col("salts")).cast("int"))
    shard = ["anchor", "salt", "streams", "id", "h", "lo", "content"]
    dealt = references.withColumn("streams", F.lit(0)).select(shard).unionByName(streams.withColumn("streams", F.lit(1)).select(shard))

    # by number: the work of a task follows its symbols, which are few bytes to Spark's own sizing
    n = max(int(keyed_partitions(docs)), -(-content.agg(F.coalesce(F.sum(F.size("content") if unit == "words" else F.length("content")), F.lit(0))).first()[0] // TASK))
    dealt = dealt.repartition(n, "anchor", "salt").sortWithinPartitions(shard[:-1])
    spans = spans.unionByName(dealt.mapInArrow(compare, f"{key}, lo long, hi long"))

    windows = spread.join(wide, "anchor").mapInArrow(window_rows(length, False), columns)
    many = hot_join(windows, least, ["one", "two"], "c", ["id", "lo"])
    if later_only:
        many = many.filter(~place.eqNullSafe(_place_of("first")))
    return spans.unionByName(many.select("id", "h", "lo", (F.col("lo") + length).alias("hi")))


def _place_of(name: str) -> Column:
    return F.struct(*(F.col(f"{name}.{c}").alias(c) for c in ("id", "h", "lo")))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with each one's spans (null if none), as an array of (lo, hi)."""
    each = spans.groupBy(F.col("id").alias("wid"), F.col("h").alias("wh")).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return docs.join(each, F.col("id").eqNullSafe(F.col("wid")) & (F.col("h") == F.col("wh")), "left").drop("wid", "wh")
