"""Audits: completeness, agreement, balance, splits, near duplicates. Each returns the rows that break a rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def completeness(planned: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with side = missing (only planned) or extra (only observed)."""
    left = planned.select(*keys).distinct().withColumn("_p", F.lit(True))
    right = observed.select(*keys).distinct().withColumn("_o", F.lit(True))
    both = left.join(right, list(keys), "full_outer").filter(F.col("_p").isNull() | F.col("_o").isNull())
    return both.select(*keys, F.when(F.col("_o").isNull(), "missing").otherwise("extra").alias("side"))


def pending(schedule: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scheduled rows that aren't done."""
    return schedule.join(done.select(*keys).distinct(), list(keys), "left_anti")


def schedule(*factors: DataFrame) -> DataFrame:
    """The full factorial of small tables of levels."""
    out = factors[0]
    for f in factors[1:]:
        out = out.crossJoin(f)
    return out


def field_mismatches(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """For each field of rows that both have: matches and mismatches, null being a value."""
    b = right.select(*keys, *(F.col(f).alias(f"_{f}") for f in fields))
    same = [F.struct(F.lit(f).alias("field"), F.col(f).eqNullSafe(F.col(f"_{f}")).alias("same")) for f in fields]
    return left.join(b, list(keys)).select(F.explode(F.array(*same)).alias("e")).groupBy("e.field").agg(F.count_if("e.same").alias("matches"), F.count_if(~F.col("e.same")).alias("mismatches"))


def balance(df: DataFrame, factors: Sequence[str], expected: int) -> DataFrame:
    """Cells of the factors' grid whose number of rows isn't the expected one, empty cells included."""
    grid = schedule(*(df.select(f).distinct() for f in factors))
    counts = df.groupBy(*factors).agg(F.count("*").alias("n"))
    return grid.join(counts, list(factors), "left").na.fill(0, ["n"]).filter(F.col("n") != expected)


def split_overlaps(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in several splits."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)


def quantized_duplicates(df: DataFrame, key: Sequence[Column], split: str) -> DataFrame:
    """Quantised keys that several splits share: key_json, n, splits."""
    name = F.to_json(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key))))
    return df.groupBy(name.alias("key_json")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)


def exact_duplicates(df: DataFrame, content: Column) -> DataFrame:
    """Content hashes that occur more than once."""
    return df.groupBy(F.sha2(content, 256).alias("content_hash")).agg(F.count("*").alias("copies")).filter("copies > 1")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with multiplicity, that one side has more often."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def invariant_report(df: DataFrame, invariants: dict[str, Column]) -> DataFrame:
    """One row for each invariant: how many rows break it (null breaks it)."""
    counts = [F.struct(F.lit(name).alias("invariant"), F.count_if(~F.coalesce(rule, F.lit(False))).alias("broken")) for name, rule in invariants.items()]
    return df.agg(F.array(*counts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def assert_empty(report: DataFrame, what: str) -> None:
    """Raise if a report of violations has rows; names the first three."""
    if rows := report.limit(3).collect():
        raise ValueError(f"{what}: {', '.join(map(str, rows))}")


def pending_first(scheduled: DataFrame, done: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` scheduled rows, in a stated order, that aren't done: what a run with a cap would do next."""
    return pending(scheduled, done, keys).orderBy(*order).limit(most)


def cross_metric(df: DataFrame, by: Sequence[str], pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Groups in which two aggregates that should agree don't: by, metric, one, other."""
    each = F.array(*(F.struct(F.lit(name).alias("metric"), F.col(f"_a{i}").cast("double").alias("one"), F.col(f"_b{i}").cast("double").alias("other")) for i, name in enumerate(pairs)))
    sums = df.groupBy(*by).agg(*(c.alias(f"_{side}{i}") for i, two in enumerate(pairs.values()) for side, c in zip("ab", two, strict=True)))
    return sums.select(*by, F.explode(each).alias("e")).select(*by, "e.*").filter(~F.col("one").eqNullSafe(F.col("other")))


def split_cover(universe: DataFrame, splits: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that aren't in exactly one split, or aren't the universe's: key, splits, fault (missing, unknown, overlap)."""
    each = splits.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    both = universe.select(key).distinct().withColumn("_u", F.lit(True)).join(each, key, "full_outer")
    fault = F.when(F.col("splits").isNull(), "missing").when(F.col("_u").isNull(), "unknown").when(F.size("splits") > 1, "overlap")
    return both.select(key, "splits", fault.alias("fault")).filter("fault IS NOT NULL")
