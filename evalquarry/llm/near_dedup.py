"""MinHash near-dedup: BagMinHash bands propose, multiset overlap of word shingles decides."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bagminhash import REGISTERS, band_keys, signatures
from .components import components
from .packed import SPACED, U64, mix, pieces, prefix_sums, span_hashes, take, words
from .shared import bounded_batches, forget, saved

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
#: A bucket with more different multisets than this is compared block by block.
BLOCK = 1000
#: Bytes of text whose multisets are in hand at once.
PIECE = 1 << 20
FORTY_EIGHT = U64(16)


def bags(piece, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a piece's documents: owner, 48-bit hash, count; and the documents' numbers of shingles."""
    w = words(piece, SPACED, lower=True)
    n = np.diff(w.bounds)
    sums, down = prefix_sums(w.hashes)
    at = np.arange(len(w.start))
    end = w.bounds[w.doc + 1]
    first = (at + size <= end) | (at == w.bounds[w.doc])  # a text of fewer words is one shingle
    at = at[first]
    hashes = span_hashes(sums, down, at, np.minimum(at + size, end[first]))
    keys = np.sort((w.doc[at].astype(U64) << U64(48)) | (hashes >> FORTY_EIGHT))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(keys)))
    keys = keys[start]
    return (keys >> U64(48)).astype(np.int64), keys & U64((1 << 48) - 1), count, np.where(n, np.maximum(n - size + 1, 1), 0)


def names(owner: np.ndarray, element: np.ndarray, count: np.ndarray, owners: int) -> pa.Array:
    """A 128-bit name of each multiset."""
    out = np.zeros((owners, 2), U64)
    if len(owner):
        at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        for i in (0, 1):
            out[owner[at], i] = np.add.reduceat(mix(element ^ mix(count.astype(U64), 51 + i), 53 + i), at)
    return pa.Array.from_buffers(pa.binary(16), owners, [None, pa.py_buffer(out)]).cast(pa.binary())


def sign(size: int, bands: int, registers: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text"), PIECE):
                owner, element, count, n = bags(piece, size)
                keys = band_keys(signatures(owner, element, count, len(n), registers), bands)
                keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*take(batch, ["id", "h"], piece.rows), names(owner, element, count, len(n)), pa.array(n), keys], names=["id", "h", "node", "n", "bands"])

    return run


def contents(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document's multiset: the hashes of its shingles in order, 48 bits in 64, then their counts in 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column("text"), PIECE):
                owner, element, count, n = bags(piece, size)
                at = np.searchsorted(owner, np.arange(len(n) + 1))
                often = count.astype(np.uint32)
                out = [element[a:b].tobytes() + often[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*take(batch, ["node"], piece.rows), pa.array(out, pa.binary())], names=["node", "content"])

    return run


def connect(bags_: list[tuple[np.ndarray, np.ndarray]], least: float) -> list[int]:
    """For each multiset the first one of its component under weighted Jaccard >= least.

    A multiset is compared at once with all that are not yet reached; those it
    reaches are not compared among themselves, so a group of copies costs a pass.
    """
    root = [-1] * len(bags_)
    element, count = (np.concatenate([b[i] for b in bags_]) for i in (0, 1))
    size = np.array([len(b[0]) for b in bags_])
    owner = np.repeat(np.arange(len(bags_)), size)
    total = np.bincount(owner, weights=count, minlength=len(bags_))
    free = np.ones(len(bags_), bool)
    for seed in range(len(bags_)):
        if not free[seed]:
            continue
        root[seed], free[seed] = seed, False
        queue = [seed]
        while queue and free.any():
            x = queue.pop()
            able = free & (np.minimum(total, total[x]) >= least * np.maximum(total, total[x]))
            if not able.any():
                continue
            if able.sum() * 4 < len(able):
                near = np.concatenate([np.arange(b, b + s) for b, s in zip((np.cumsum(size) - size)[able], size[able], strict=True)])
            else:
                near = np.flatnonzero(able[owner])
            mine, counts = bags_[x]
            at = np.minimum(np.searchsorted(mine, element[near]), len(mine) - 1)
            both = np.where(mine[at] == element[near], np.minimum(counts[at], count[near]), 0)
            overlap = np.bincount(owner[near], weights=both, minlength=len(bags_))
            found = np.flatnonzero(able & (overlap >= least * (total[x] + total - overlap) - 1e-9))
            free[found] = False
            for f in found.tolist():
                root[f] = seed
            queue += found.tolist()
    return root


def verify(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of the buckets of a partition; rows are sorted by bucket and node."""

    def links(rows: list[tuple[bytes, bytes]]) -> Iterator[tuple[bytes, bytes]]:
        nodes = list(dict(rows))
        bags_ = []
        for content in dict(rows).values():
            n = len(content) // 12
            bags_.append((np.frombuffer(content, U64, n), np.frombuffer(content, np.uint32, n, 8 * n).astype(np.int64)))
        if len(nodes) > 1:
            for node, root in zip(nodes, connect(bags_, least), strict=True):
                if node != nodes[root]:
                    yield node, nodes[root]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for g, node, content in zip(batch.column("bucket").to_pylist(), batch.column("node").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if g != group:
                    found += links(rows)
                    group, rows = g, []
                rows.append((node, content))
            yield _pairs(found)
        yield _pairs(list(links(rows)))

    return run


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, registers: int = REGISTERS) -> DataFrame:
    """Each document's class of near duplicates: id_col, text_hash, class_id, n_shingles, first.

    Words are lower-cased runs of non-space characters; a text is the multiset of
    its runs of ``shingle`` words (one run if it has fewer words). Texts are
    linked if they share a BagMinHash band and their weighted Jaccard index is at
    least ``similarity``; classes are the connected components, named by their
    least id. With 20 bands of 5 registers a pair at 0.8 is missed with a
    probability of 0.0004. The overlap is counted on 48-bit hashes of shingles.
    An empty table has no classes. ``first`` marks one row of each class (repeated rows of
    equal id and text are all marked). Empty and null texts are classes of their
    own. A null id counts as the smallest. Other columns play no part.
    """
    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()
    signed = saved(keyed.mapInArrow(sign(shingle, bands, registers), f"id {kind}, h long, node binary, n long, bands array<long>"), "signatures")
    full = signed.filter("n > 0")
    nodes = full.groupBy("node").agg(F.min(F.struct("id", "h")).alias("rep"), F.any_value("bands").alias("bands"))
    nodes = saved(nodes, "nodes")
    buckets = nodes.select(F.explode("bands").alias("key"), "node")
    mark = F.xxhash64("node")
    groups = buckets.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(mark).alias("x"), F.min(mark).alias("a"), F.max(mark).alias("b")).filter("c > 1")
    once = groups.groupBy("c", "x", "a", "b").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    members = saved(buckets.join(once, "key"), "members")

    wanted = members.select("node").distinct().join(nodes.select("node", "rep"), "node").select("node", F.col("rep.id").alias("wid"), F.col("rep.h").alias("wh"))
    texts = keyed.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("h") == F.col("wh"))).select("node", "text")
    content = texts.mapInArrow(contents(shingle), "node binary, content binary")
    own = F.pmod(mark, F.col("blocks")).cast("int")
    split = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select("node", F.xxhash64("key", F.least(own, "other"), F.greatest(own, "other")).alias("bucket"))
    met = split.join(content, "node").repartition("bucket").sortWithinPartitions("bucket", "node")
    star = components(met.mapInArrow(verify(similarity), "a binary, b binary"))
    forget(members)

    rooted = nodes.select("node", "rep").join(star, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("lead"))
    named = rooted.join(least, "root").select("node", "lead")
    out = signed.select("id", "h", "node", "n").join(named, "node", "left")
    lead = F.when(F.col("n") > 0, F.col("lead")).otherwise(F.struct("id", "h"))
    return out.select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), lead["id"].alias("class_id"), F.col("n").alias("n_shingles"), F.struct("id", "h").eqNullSafe(lead).alias("first"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """docs with one document of each class: the one of least id, in docs' columns.

    Rows of equal id and text are one document, of which one row stays (any one of
    them: they may differ in other columns). Null and empty texts are classes of
    their own. A row travels as a whole beside its key, so no name of docs' columns
    is taken; an empty table stays empty. Texts are shuffled once, by (id, hash).
    """
    mark = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    kept = near_duplicates(docs, id_col, text_col, **options).filter("first").select(F.struct(F.col(id_col).alias("id"), F.col("text_hash").alias("h")).alias("mark"))
    rows = docs.select(mark.alias("mark"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(kept, "mark", "left_semi").dropDuplicates(["mark"]).select("row.*")
