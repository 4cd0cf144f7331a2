"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packed import ranges
from .shared import bounded_batches, saved

BITS = 64
PARTS = 4
#: Share of a sample's true neighbours that the Hamming radius must hold; the radius is learned so.
RECALL = 0.97
#: Vectors that the rotation is learned from, at most: those of least hash.
SAMPLE = 10_000
#: Vectors indexed by one task, or so, and queries that travel as one row.
INDEX_BLOCK = 16_384
QUERY_BLOCK = 512
#: Bytes of queries that a task answers before another one indexes the same vectors.
QUERY_BYTES = 1 << 30


@dataclass
class Rotation:
    """Centre, projection to BITS numbers (their signs are the code), and the norm that augmentation fills up to."""

    centre: np.ndarray
    project: np.ndarray
    norm: float

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """One number of 64 bits for each vector. Vectors get the component that makes all norms equal; queries get 0."""
        norms = np.einsum("ij,ij->i", x, x)
        if query:  # a query's length doesn't change its order of inner products
            x = x / np.sqrt(norms)[:, None] * self.norm
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - norms, 0))
        bits = (np.column_stack([x, extra]) - self.centre) @ self.project > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def learn(x: np.ndarray, norm: float, bits: int = BITS, rounds: int = 15) -> Rotation:
    """Iterative quantisation: principal axes, then the rotation that brings them closest to their signs."""
    x = np.column_stack([x, np.sqrt(np.maximum(norm**2 - np.einsum("ij,ij->i", x, x), 0))])
    centre = x.mean(axis=0)
    x = x - centre
    _, _, axes = np.linalg.svd(x.T @ x)
    axes = axes[:bits].T
    if axes.shape[1] < bits:  # fewer dimensions than bits: the rotation spreads them
        axes = np.column_stack([axes, np.zeros((len(axes), bits - axes.shape[1]))])
    flat = x @ axes
    turn = np.linalg.qr(np.random.default_rng(11).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(flat @ turn).T @ flat)
        turn = (u @ v).T
    return Rotation(centre, axes @ turn, norm)


def learn_radius(rotation: Rotation, x: np.ndarray, k: int, total: int, recall: float = RECALL, asked: int = 300) -> int:
    """The radius that holds a share of the true neighbours among sampled vectors.

    Of a sample of n in ``total`` vectors the nearest k n / total are what the k
    nearest of all are; for a small sample of very many at least the first one is
    taken, which is farther, so the radius errs to the wide side.
    """
    if len(x) < 2:
        return BITS
    q = np.arange(0, len(x), max(1, len(x) // asked))
    near = min(len(x) - 1, max(1, -(-k * len(x) // total)))
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -np.inf
    at = np.argpartition(-scores, near - 1, axis=1)[:, :near]
    apart = np.bitwise_count(rotation.codes(x[q], query=True)[:, None] ^ rotation.codes(x)[at])
    return int(np.ceil(np.quantile(apart, recall)))


def balls(width: int, reach: int) -> np.ndarray:
    """All numbers of ``width`` bits with at most ``reach`` ones: XOR with a value gives the ball around it."""
    every = np.arange(1 << width, dtype=np.uint32)
    return every[np.bitwise_count(every) <= reach]


def reaches(radius: int, parts: int) -> list[int]:
    """The pigeonhole bound of each part: codes within ``radius`` bits agree so far in some part.

    With radius = parts * s + a, the first a + 1 parts are searched to s bits and
    the others to s - 1 (-1: not at all): differing by more in each part makes more
    than radius bits in sum.
    """
    s, a = divmod(radius, parts)
    return [s if p <= a else s - 1 for p in range(parts)]


class MultiIndex:
    """Tables of code substrings of a block of vectors.

    Each part's table has, for each of the substring's values, where its codes
    begin in the part's order, so a value is looked up by its number.
    """

    def __init__(self, codes: np.ndarray, parts: int = PARTS) -> None:
        self.codes, self.parts, self.width = codes, parts, BITS // parts
        self.touched = self.looked_up = 0
        self.tables = []
        for p in range(parts):
            sub = self.substring(codes, p)
            begin = np.zeros((1 << self.width) + 1, np.int64)
            np.cumsum(np.bincount(sub, minlength=1 << self.width), out=begin[1:])
            self.tables.append((np.flatnonzero(np.diff(begin)).astype(np.uint32), begin, np.argsort(sub, kind="stable")))

    def substring(self, codes: np.ndarray, p: int) -> np.ndarray:
        return ((codes >> np.uint64(p * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.uint32)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Places of all codes within ``radius`` bits: the ball around each substring is looked up in its table.

        A ball of more values than the table has is the worse way round: then the
        table's values are looked up in the ball.
        """
        near = np.zeros(len(self.codes), bool)
        for p, ((values, begin, order), reach) in enumerate(zip(self.tables, reaches(radius, self.parts), strict=True)):
            if reach < 0:
                continue
            own = self.substring(code, p)
            ball = _BALLS.setdefault((self.width, reach), None)
            if ball is None:
                ball = _BALLS[self.width, reach] = balls(self.width, reach)
            if len(ball) <= len(values):
                hit = ball ^ own
                self.looked_up += len(ball)
            else:
                hit = values[np.bitwise_count(values ^ own) <= reach]
                self.looked_up += len(values)
            near[order[ranges(begin[hit], begin[hit + 1] - begin[hit])]] = True
        at = np.flatnonzero(near)
        self.touched += len(at)
        return at[np.bitwise_count(self.codes[at] ^ code) <= radius]


_BALLS: dict[tuple[int, int], np.ndarray | None] = {}


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def packed(dim: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries (id, vector) as rows of ``size`` of them or fewer: (ids, many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([matrix(part.column("vector"), dim).tobytes()], pa.binary())], names=["ids", "many"])

    return run


def search(held: Callable, dim: int, k: int, parts: int, radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each query its block's nearest distinct vectors: (query_id, score, ids).

    Rows come by block, its vectors ahead of its queries: the vectors are indexed,
    and rows of queries pass one after the other, so only the block is held.
    """

    def answers(x: np.ndarray, ids: pa.Array, index: MultiIndex, rotation: Rotation, names: list[int], queries: np.ndarray) -> pa.RecordBatch:
        out_q, out_at, out_s = [], [], []
        need = min(k + 1, len(x))
        for q, code in enumerate(rotation.codes(queries, query=True)):
            reach = radius
            at = index.within(code, reach)
            while len(at) < need and reach < BITS:  # too few within the radius: it grows until the block is through
                reach = min(BITS, reach + 2 * parts)
                at = index.within(code, reach)
            score = np.einsum("ij,j->i", x[at], queries[q])
            if len(at) > need:
                best = np.flatnonzero(score >= np.partition(score, -need)[-need])
                at, score = at[best], score[best]
            out_q.append(np.full(len(at), names[q], np.int64)), out_at.append(at), out_s.append(score)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_s)), ids.take(pa.array(np.concatenate(out_at)))], names=["query_id", "score", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = held()
        block, rows, index = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            key, asks = np.asarray(batch.column("block")), np.asarray(batch.column("asks"))
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(batch)]
            for at, to in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(at, to - at)
                if key[at] != block:
                    block, rows, index = key[at], [], None
                if not asks[at]:
                    rows.append(part)
                    continue
                if not rows:
                    continue
                if index is None:
                    table = pa.Table.from_batches(rows)
                    x, ids = matrix(table["vector"].combine_chunks(), dim), table["ids"].combine_chunks()
                    index = MultiIndex(rotation.codes(x), parts)
                for i in range(len(part)):
                    names, many = part.column("ids")[i].as_py(), part.column("many")[i].as_buffer()
                    yield answers(x, ids, index, rotation, names, np.frombuffer(many, np.float64).reshape(-1, dim))

    return run


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not empty or zero, all components finite numbers."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0)


def nearest(vectors: DataFrame, queries: Column | Callable[[Column], Column], id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, parts: int = PARTS, radius: int | None = None, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest found of each query by inner product: query_id, rank, vec_id, score.

    queries: a condition on id_col that says which rows are queries; candidates are
    all rows but the query's own. Scores are inner products in double precision;
    equal ones are ranked by id. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do null ids or vectors whose length is not
    the most frequent one. Equal vectors are indexed once with their k + 1 least ids, which is all
    that a list of k can show, so copies form no hot bucket. Repeated rows of one id
    count once; an id with several vectors has the least of them (by the first component
    that differs), as query and as candidate. With no usable vector the result is empty. The Hamming radius is
    learned to hold RECALL of a sample's neighbours unless it is given. Other
    columns play no part, whatever their names.

    Vectors are indexed in blocks of ``index_block`` or so; the stated queries
    travel as rows of ``query_block`` in a shuffle, and no vector but the sample's
    passes the driver.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(F.col("id").isNotNull())
    given = given.filter(usable(F.col("vector")))
    shape = given.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], empty)
    dim = shape["dim"]
    given = given.filter(F.size("vector") == dim).groupBy("id").agg(F.min("vector").alias("vector"))
    # Spark limits the rows of each vector before it shuffles them
    order = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = given.withColumn("place", order).filter(F.col("place") <= k + 1)
    distinct = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = saved(distinct, "vectors")
    size, norm = distinct.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)))).first()
    sample = distinct.select("vector").orderBy(F.xxhash64("vector"), F.col("ids")[0]).limit(SAMPLE).toArrow()
    known = matrix(sample["vector"].combine_chunks(), dim)
    rotation = learn(known, norm)
    radius = learn_radius(rotation, known, k, size) if radius is None else radius
    blocks = max(1, -(-size // index_block))

    asked = given.filter(queries(F.col("id")) if callable(queries) else queries)
    asked = saved(asked.mapInArrow(packed(dim, query_block), "ids array<long>, many binary"), "queries")
    slices = max(1, -(-asked.agg(F.coalesce(F.sum(F.octet_length("many")), F.lit(0))).first()[0] // QUERY_BYTES))
    # every block of vectors meets every row of queries once, in the task of its block (and slice of the queries)
    own = F.pmod(F.xxhash64("vector"), F.lit(blocks)).cast("int")
    index = distinct.withColumn("block", F.explode(F.sequence(own * slices, own * slices + (slices - 1)))).select("block", F.lit(0).alias("asks"), "ids", "vector", F.lit(None).cast("binary").alias("many"))
    slice_ = F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int")
    asking = asked.withColumn("block", F.explode(F.sequence(slice_, slice_ + slices * (blocks - 1), F.lit(slices)))).select("block", F.lit(1).alias("asks"), "ids", F.lit(None).cast("array<double>").alias("vector"), "many")
    held = spark.sparkContext.broadcast(rotation)  # BITS numbers for each dimension
    dealt = index.unionByName(asking).repartitionById(blocks * slices, "block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(search(lambda: held.value, dim, k, parts, radius), "query_id long, score double, ids array<long>")
    each = found.withColumn("ids", F.filter("ids", lambda i: i != F.col("query_id"))).select("query_id", "score", F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
