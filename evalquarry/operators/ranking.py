"""Order, ranks, last writers, representatives, running records."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_rank
from .stable import checkpointed


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row written for each key; null keys are dropped. A map-side aggregation, no sort."""
    whole = F.struct(*(F.col(c) for c in df.columns))
    sequence = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.max_by(whole, sequence).alias("_w")).select("_w.*")


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    whole = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(*keys).agg(F.min_by(whole, F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("_w")).select("_w.*")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def domain_order(value: Column, domain: Sequence[str]) -> Column:
    """A sort key that follows the domain's order, others last."""
    at = F.array_position(F.array(*map(F.lit, domain)), value)
    return F.when(at > 0, at).otherwise(len(domain) + 1)


def shuffled(df: DataFrame, seed: str, *keys: Column) -> DataFrame:
    """df with shuffle_key: sorting by it is a shuffle that every run repeats."""
    return df.withColumn("shuffle_key", stable_rank(F.lit(seed), *keys))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "number") -> DataFrame:
    """df with a number from 1 for each row, in one order of all rows, without a task that holds them all.

    The rows are dealt to tasks by ranges of the order and sorted there; each then has
    its place in its range. The ranges' sizes, one row for each, give the numbers at
    which they begin. Ranges are drawn from a sample, so the sorted rows are kept by a
    checkpoint before anything is counted. Rows that are equal in the order are
    numbered in any way: give it a key that tells them apart.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # the partition, and the row's place in its 33 lower bits
    kept = checkpointed(dealt.select("*", F.shiftright(place, 33).alias("_range"), place.bitwiseAND((1 << 33) - 1).alias("_place")))
    sizes = sorted((r["_range"], r["n"]) for r in kept.groupBy("_range").agg(F.count("*").alias("n")).collect())  # a row for each range, not for each row
    starts = list(zip((k for k, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    starts = df.sparkSession.createDataFrame(starts, "_range long, _before long")
    out = kept.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_place") + 1)
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c != name), name)


def sequence_ids(df: DataFrame, prefix: str, by: Sequence[str], order: Sequence[Column], width: int = 4) -> DataFrame:
    """df with sequence_id, the prefix and a number of at least ``width`` digits: within each group, or of all rows without ``by``."""
    digits = lambda n: F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n)
    if not by:
        out = numbered(df, order, "_number")
        return out.withColumn("sequence_id", F.concat(F.lit(prefix), digits(F.col("_number").cast("string")))).drop("_number")
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("sequence_id", F.concat(F.lit(prefix), digits(number.cast("string"))))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Pearson's correlation of the ranks (equal values share their least rank); 0 for one row or a constant."""
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c))
    ranked = df.withColumns({"_x": rank(x).cast("double"), "_y": rank(y).cast("double")})
    rho = F.corr("_x", "_y")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.isnan(rho), 0.0).otherwise(F.coalesce(rho, F.lit(0.0))).alias("rho"))


def mean_ranking(df: DataFrame, item: str, score: str) -> DataFrame:
    """Items by mean score, densely ranked; one row for each item goes to the ranking task."""
    means = df.groupBy(item).agg(F.avg(score).alias("mean_score"))
    return means.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("mean_score"))))


def adjacent_gaps(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """The difference to the next value in the group's order; null for the last."""
    return df.withColumn("gap", F.lead(value).over(Window.partitionBy(*by).orderBy(*order)) - F.col(value))


def running_best(df: DataFrame, by: Sequence[str], order: Sequence[Column], score: str) -> DataFrame:
    """best so far, whether the row sets it, and stale: rows since the record."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumns({"best": F.max(score).over(w.rowsBetween(Window.unboundedPreceding, 0)), "is_record": before.isNull() | (F.col(score) > before), "_i": F.row_number().over(w)})
    last = F.max(F.when(F.col("is_record"), F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("stale", F.col("_i") - last).drop("_i")


def representatives(df: DataFrame, specs: Sequence[tuple[str, Column]], key: str, order: Sequence[Column]) -> DataFrame:
    """A row for each spec in turn, none twice: the first that meets it and isn't taken.

    The first len(specs) rows that meet a spec suffice for it whatever the earlier
    ones take, so that many of each are kept and the choice is made on them.
    """
    n = len(specs)
    ordered = Window.partitionBy("_s").orderBy(*order, key)
    each = df.withColumn("_s", F.explode(F.filter(F.array(*(F.when(c, F.lit(i)) for i, (_, c) in enumerate(specs))), lambda s: s.isNotNull())))
    few = each.withColumn("_o", F.row_number().over(ordered)).filter(F.col("_o") <= n)
    taken: set = set()
    chosen: list[tuple[int, object]] = []
    rows = few.select("_s", "_o", key).orderBy("_s", "_o").collect()  # at most n * n keys
    for i in range(n):
        for row in rows:
            if row["_s"] == i and row[key] not in taken:
                taken.add(row[key])
                chosen.append((i, row[key]))
                break
    names = df.sparkSession.createDataFrame([(specs[i][0], i, k) for i, k in chosen], f"spec string, spec_order int, {key} {df.schema[key].dataType.simpleString()}")
    return df.join(F.broadcast(names), key)


def balanced_choice(df: DataFrame, by: Sequence[str], order: Sequence[str], options: str, seed: str) -> DataFrame:
    """Within each group, in order, the option used least so far (ties: least hash): an ordered fold, so a group is one task's."""
    import hashlib

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, chosen string"

    def fold(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups:
            g = g.sort_values(list(order), kind="stable")
            used: dict[str, int] = {}
            picks = []
            for row in g.itertuples(index=False):
                best = min(getattr(row, options), key=lambda o: (used.get(o, 0), hashlib.sha256(f"{seed}\0{o}".encode()).hexdigest()))
                used[best] = used.get(best, 0) + 1
                picks.append(best)
            yield g.assign(chosen=picks)

    return df.groupBy(*by).applyInPandas(lambda g: next(fold(iter([g]))), schema)
