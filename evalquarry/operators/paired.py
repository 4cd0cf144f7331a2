"""Paired comparisons: baselines, transitions, exact McNemar."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Below so many, the lesser count's terms are added one by one.
FEW = 16
#: Nodes of the integral beyond: its integrand falls by a factor of e^45 at most between 0 and the last one.
NODES = 64


def _stirling(n: Column) -> Column:
    """log n! less the logarithm of sqrt(2 pi n) (n / e)^n, for n of FEW or more: the first terms of its series."""
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / (n * n)) / (n * n)) / (n * n)) / (n * n)) / n


def exact_binomial(a: Column, b: Column) -> Column:
    """Two-sided exact sign test of a against b discordant pairs; 1 without any, null if a count is null.

    Twice the tail of the binomial distribution up to the lesser count k of n. Up to
    FEW terms are added. Beyond, the tail is (n - k) times its last term times

        integral over x from 0 to 1 of (1 - x)^(n - k - 1) (1 + x)^k,

    whose integrand falls from 1 without a turn, so Gauss-Legendre nodes up to where
    it vanishes give it to the last digits. The last term comes from Stirling's
    series. Both are written so that nothing large cancels. The work is the same for
    any counts: there is no array of terms and no loop over them.
    """
    from numpy.polynomial.legendre import leggauss

    n, k = (a + b).cast("double"), F.least(a, b).cast("double")
    terms = F.sequence(F.lit(1), F.greatest(F.least(k, F.lit(FEW - 1)).cast("int"), F.lit(1)))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    step = lambda acc, i: F.struct((acc["t"] * (n - i + 1) / i).alias("t"), (acc["s"] + F.when(k >= i, acc["t"] * (n - i + 1) / i).otherwise(0.0)).alias("s"))
    sum_of_few = F.aggregate(terms, start, step, lambda acc: acc["s"])
    few = F.when(n <= 1000, sum_of_few * F.pow(F.lit(2.0), 1 - n)).otherwise(F.exp(F.log(sum_of_few) - (n - 1) * math.log(2)))

    excess = n - 2 * k - 1  # the integrand is exp(k log(1 - x^2) + excess log(1 - x))
    reach = F.least(F.lit(1.0), 90 / (excess + F.sqrt(excess * excess + 180 * k)))
    nodes = F.array(*(F.struct(F.lit(float((x + 1) / 2)).alias("x"), F.lit(float(w / 2)).alias("w")) for x, w in zip(*leggauss(NODES), strict=True)))
    at = lambda z: z["w"] * F.exp(k * F.log1p(-(z["x"] * reach) * (z["x"] * reach)) + excess * F.log1p(-z["x"] * reach))
    integral = reach * F.aggregate(nodes, F.lit(0.0), lambda s, z: s + at(z))
    off = (n - 2 * k) / n
    spread = n / 2 * (F.log1p(-off * off) + off * F.log1p(2 * off / (1 - off)))  # n times the divergence of k / n from a half
    last = F.exp(_stirling(n) - _stirling(k) - _stirling(n - k) - spread) * F.sqrt(n / (2 * math.pi * k * (n - k)))
    many = 2 * (n - k) * last * integral
    return F.when(n.isNotNull(), F.when(n - 2 * k <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.when(k < FEW, few).otherwise(many))))


def with_baseline(df: DataFrame, unit: Sequence[str], condition: str, baseline: str, value: str, name: str = "baseline") -> DataFrame:
    """df with the value that the baseline condition has in the same unit: a window, so one shuffle and no self-join."""
    own = F.when(F.col(condition) == baseline, F.col(value))
    return df.withColumn(name, F.max(own).over(Window.partitionBy(*unit)))


def null_safe_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], suffix: str = "_right") -> DataFrame:
    """Inner join on keys of which null is a value like others; the right side's columns get the suffix."""
    named = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(c).alias(c + suffix) for c in columns))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(named, on).drop(*(f"_{k}" for k in keys))


def mcnemar(df: DataFrame, flag: Column, base: Column, by: Sequence[str]) -> DataFrame:
    """Of rows that have a baseline: both accuracies, their difference, discordant counts and the exact p."""
    out = df.filter(base.isNotNull() & flag.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("paired_n"), F.avg(flag.cast("int")).alias("accuracy"), F.avg(base.cast("int")).alias("baseline_accuracy"),
        F.count_if(flag & ~base).alias("gained"), F.count_if(~flag & base).alias("lost"),
    )
    return out.withColumns({"delta": F.col("accuracy") - F.col("baseline_accuracy"), "p_value": exact_binomial(F.col("gained"), F.col("lost"))})


def paired_table(df: DataFrame, unit: Sequence[str], condition: str, left: str, right: str, flag: str, by: Sequence[str] = ()) -> DataFrame:
    """Units that have both conditions: both, left_only, right_only, neither, difference in points, exact p."""
    has = lambda c: F.max(F.when(F.col(condition) == c, F.col(flag).cast("int")))
    wide = df.filter(F.col(condition).isin(left, right)).groupBy(*dict.fromkeys([*by, *unit])).agg(has(left).alias("_l"), has(right).alias("_r")).dropna(subset=["_l", "_r"])
    a, b = F.col("_l") == 1, F.col("_r") == 1
    out = wide.groupBy(*by).agg(F.count("*").alias("paired_n"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only"), F.count_if(~a & ~b).alias("neither"))
    points = F.try_divide((F.col("right_only") - F.col("left_only")) * 100.0, F.col("paired_n"))
    return out.withColumns({"delta_points": points, "p_value": exact_binomial(F.col("left_only"), F.col("right_only"))})


def contrasts(df: DataFrame, unit: Sequence[str], condition: str, levels: Sequence[str], flag: str) -> DataFrame:
    """paired_table for every two levels of a factor, from one aggregation by unit.

    Each unit becomes one row with an array of its levels' results, which is
    exploded by the fixed list of contrasts.
    """
    has = [F.max(F.when(F.col(condition) == c, F.col(flag).cast("int"))) for c in levels]
    wide = df.filter(F.col(condition).isin(*levels)).groupBy(*unit).agg(F.array(*has).alias("_v"))
    pairs = F.array(*(F.struct(F.lit(levels[i]).alias("left"), F.lit(levels[j]).alias("right"), F.col("_v")[i].alias("l"), F.col("_v")[j].alias("r")) for i, j in combinations(range(len(levels)), 2)))
    rows = wide.select(F.explode(pairs).alias("e")).select("e.*").dropna(subset=["l", "r"])
    a, b = F.col("l") == 1, F.col("r") == 1
    out = rows.groupBy("left", "right").agg(F.count("*").alias("paired_n"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only"), F.count_if(~a & ~b).alias("neither"))
    return out.withColumn("p_value", exact_binomial(F.col("left_only"), F.col("right_only")))


def transitions(df: DataFrame, before: Column, after: Column, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """How labels a and b move between two versions; rows with other labels are invalid and counted apart."""
    fine = F.coalesce(before.isin(a, b) & after.isin(a, b), F.lit(False))
    out = df.groupBy(*by).agg(
        F.count_if(fine).alias("valid"), F.count_if(~fine).alias("invalid"), F.count_if(fine & (before == a) & (after == a)).alias("unchanged_a"), F.count_if(fine & (before == b) & (after == b)).alias("unchanged_b"),
        F.count_if(fine & (before == a) & (after == b)).alias("a_to_b"), F.count_if(fine & (before == b) & (after == a)).alias("b_to_a"),
    )
    return out.withColumn("net_to_b", F.col("a_to_b") - F.col("b_to_a"))


def correctness_transitions(df: DataFrame, before: Column, after: Column, fields: dict[str, tuple[Column, Column]], by: Sequence[str] = ()) -> DataFrame:
    """Kept, gained, lost, still wrong, and for each field how often it changed (null is a value)."""
    return df.groupBy(*by).agg(
        F.count_if(before & after).alias("kept"), F.count_if(~before & after).alias("gained"), F.count_if(before & ~after).alias("lost"), F.count_if(~before & ~after).alias("still_wrong"),
        *(F.count_if(~x.eqNullSafe(y)).alias(f"changed_{name}") for name, (x, y) in fields.items()),
    )


def toward_reference(df: DataFrame, value: Column, baseline: Column, reference: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows that differ from the baseline, and whether they moved to the reference or away from it."""
    changed = ~value.eqNullSafe(baseline)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(changed).alias("changed"), F.count_if(changed & value.eqNullSafe(reference)).alias("toward"), F.count_if(changed & baseline.eqNullSafe(reference)).alias("away"))
