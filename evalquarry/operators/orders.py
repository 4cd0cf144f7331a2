"""Best orders from votes on pairs: exact Kemeny orders by a search over subsets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids that the search takes at most, and orders of a row that it lists.
MOST_IDS = 12
MOST_ORDERS = 50_000
#: Cells of the subsets' tables that a task holds at once.
CELLS = 1 << 20


def vote_matrix(ids: Column, votes: Column) -> Column:
    """For sorted ids: how many votes put the i-th before the j-th, at i * n + j."""
    n = F.size(ids)
    cells = F.when(n > 0, F.sequence(F.lit(0), n * n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(cells, lambda p: F.coalesce(F.size(F.filter(votes, lambda v: (v["a"] == F.get(ids, F.floor(p / n).cast("int"))) & (v["b"] == F.get(ids, p % n)))), F.lit(0)))


def best_subsets(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From matrices (rows, n, n), for each subset: the most votes that an order of it keeps, the number of such orders, and the members that one may begin with, as bits.

    An order of a subset begins with a member i, which keeps i's votes against the
    others, and goes on with a best order of those: subsets in turn, smaller ones first.
    """
    rows, n, _ = votes.shape
    ahead = np.zeros((rows, n, 1 << n), np.int32)  # votes that put i before the members of a subset
    for s in range(1, 1 << n):
        ahead[:, :, s] = ahead[:, :, s & (s - 1)] + votes[:, :, (s & -s).bit_length() - 1]
    kept, ways, heads = np.zeros((rows, 1 << n), np.int32), np.zeros((rows, 1 << n), np.int64), np.zeros((rows, 1 << n), np.int32)
    ways[:, 0] = 1
    for s in range(1, 1 << n):
        members = [i for i in range(n) if s >> i & 1]
        rest = [s ^ 1 << i for i in members]
        scores = kept[:, rest] + ahead[:, members, rest]
        kept[:, s] = scores.max(axis=1)
        best = scores == kept[:, s, None]
        ways[:, s] = (ways[:, rest] * best).sum(axis=1)
        heads[:, s] = (best * np.array([1 << i for i in members])).sum(axis=1)
    return kept, ways, heads


def listed(heads: np.ndarray, n: int, most: float) -> list[list[int]]:
    """A row's best orders from its subsets' heads, the least first; ``most`` of them."""
    orders, stack = [], [((1 << n) - 1, [])]
    while stack and len(orders) < most:  # the least member is put last, so that it comes off first
        left, order = stack.pop()
        if not left:
            orders.append(order)
        stack += [(left ^ 1 << i, [*order, i]) for i in reversed(range(n)) if left and heads[left] >> i & 1]
    return orders


def kemeny(df: DataFrame, ids: Column, votes: Column, name: str = "best", every: bool = False) -> DataFrame:
    """df with a struct: kept, the most votes that an order of the ids keeps; n_best, how many orders do; first, the least of those.

    With ``every`` also orders, all of them, the least first; more than MOST_ORDERS in
    a row are an error. Votes are structs a, b: a before b; those on other ids
    don't count. Up to MOST_IDS different ids are exact, more are an error. Null ids
    give a null, no ids one empty order, null votes are none. A row's work is bounded
    by 2 to the number of its ids; nothing is shuffled.
    """
    plain = F.array_sort(ids)
    checked = F.when(F.size(plain) <= MOST_IDS, plain).when(F.size(plain) > MOST_IDS, F.raise_error(F.concat(F.size(plain).cast("string"), F.lit(f" ids are more than {MOST_IDS}"))))
    prepared = df.withColumn("_ids", checked).withColumn("_matrix", F.when(F.col("_ids").isNotNull(), vote_matrix(F.col("_ids"), votes)))
    found = T._parse_datatype_string("_found struct<kept: int, n_best: bigint, first: array<int>, orders: array<array<int>>>")
    kind = pa.struct([("kept", pa.int32()), ("n_best", pa.int64()), ("first", pa.list_(pa.int32())), ("orders", pa.list_(pa.list_(pa.int32())))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrices = batch.column("_matrix")
            sizes = np.array([len(m) if m.is_valid else -1 for m in matrices])
            out: list = [None] * len(batch)
            for size in np.unique(sizes[sizes >= 0]):
                n, at = math.isqrt(int(size)), np.flatnonzero(sizes == size)
                step = max(1, CELLS // (max(n, 1) << n))
                for part in (at[a : a + step] for a in range(0, len(at), step)):
                    cube = np.array([matrices[int(i)].as_py() for i in part], np.int32).reshape(len(part), n, n)
                    kept, ways, heads = best_subsets(cube)
                    for row, place in enumerate(part):
                        if every and ways[row, -1] > MOST_ORDERS:
                            raise ValueError(f"{ways[row, -1]} best orders are more than the {MOST_ORDERS} that are listed")
                        orders = listed(heads[row], n, math.inf if every else 1)
                        out[place] = {"kept": int(kept[row, -1]), "n_best": int(ways[row, -1]), "first": orders[0], "orders": orders if every else None}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "_found"])

    mapped = prepared.mapInArrow(search, T.StructType([*prepared.schema.fields, *found.fields]))
    named = lambda order: F.transform(order, lambda i: F.get("_ids", i))
    fields = [F.col("_found.kept").alias("kept"), F.col("_found.n_best").alias("n_best"), named("_found.first").alias("first")]
    fields += [F.transform("_found.orders", named).alias("orders")] if every else []
    return mapped.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.when(F.col("_found").isNotNull(), F.struct(*fields)).alias(name))
