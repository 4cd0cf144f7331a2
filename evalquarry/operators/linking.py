"""Joins between versions of an experiment and between its tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rekeyed(df: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """df with a key's leading ``old`` written ``new``, as another version names it; other keys stay."""
    return df.withColumn(key, F.when(F.col(key).startswith(old), F.concat(F.lit(new), F.substring(F.col(key), len(old) + 1, 1 << 20))).otherwise(F.col(key)))


def covered_subset(df: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of df whose keys the baseline has; raises if a baseline key has no row."""
    if rows := baseline.select(*keys).distinct().join(df, list(keys), "left_anti").limit(3).collect():
        raise ValueError(f"without a row: {rows}")
    return df.join(baseline.select(*keys).distinct(), list(keys), "left_semi")


def side_by_side(tables: dict[str, DataFrame], keys: Sequence[str], columns: dict[str, Sequence[str]]) -> DataFrame:
    """Rows that all tables have, each table's columns prefixed by its name."""
    parts = [df.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in columns[name])) for name, df in tables.items()]
    return reduce(lambda a, b: a.join(b, list(keys)), parts)


def referenced(schedule: DataFrame, upstream: DataFrame, foreign: str, key: str, valid: Column) -> DataFrame:
    """The schedule with its upstream rows; raises if one is missing or breaks the rule."""
    joined = schedule.join(upstream, schedule[foreign] == upstream[key], "left")
    bad = joined.filter(F.col(key).isNull() | ~F.coalesce(valid, F.lit(False)))
    if rows := bad.select(foreign).limit(3).collect():
        raise ValueError(f"missing or inconsistent upstream: {rows}")
    return joined


def matching_inputs(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """How many paired rows agree on all fields (null is a value), and on how many keys."""
    b = right.select(*keys, *(F.col(f).alias(f"_{f}") for f in fields))
    same = reduce(lambda x, y: x & y, (F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields))
    return left.join(b, list(keys)).agg(F.count("*").alias("paired"), F.count_if(same).alias("matching"))


def prefixed_pivot(df: DataFrame, by: Sequence[str], over: str, domain: Sequence[object], aggs: dict[str, Column]) -> DataFrame:
    """Aggregates of each label of the domain side by side, as <label>_<name>; every aggregate sees only its label's rows."""
    from pyspark.sql.functions import when

    out = []
    for d in domain:
        for name, value in aggs.items():
            out.append(F.avg(when(F.col(over) == d, value)).alias(f"{d}_{name}"))
        out.append(F.count_if(F.col(over) == d).alias(f"{d}_n"))
    return df.groupBy(*by).agg(*out)


def condition_agreement(df: DataFrame, unit: Sequence[str], condition: str, match: Column, k: int, conditions: int) -> DataFrame:
    """For each condition how many units match in all, some or none of k repeats; with condition null, how many match in all k of all conditions."""
    each = df.groupBy(*unit, condition).agg(F.count_if(match).alias("m"))
    by = each.groupBy(condition).agg(F.count_if(F.col("m") == k).alias("all"), F.count_if((F.col("m") > 0) & (F.col("m") < k)).alias("mixed"), F.count_if(F.col("m") == 0).alias("none"))
    total = each.groupBy(*unit).agg(F.min("m").alias("least"), F.count("*").alias("c"))
    whole = total.agg(F.count_if((F.col("least") == k) & (F.col("c") == conditions)).alias("all"), F.count_if((F.col("least") < k) | (F.col("c") < conditions)).alias("mixed"), F.lit(0).cast("bigint").alias("none"))
    return by.unionByName(whole.withColumn(condition, F.lit(None).cast(by.schema[condition].dataType)))


def two_truths(predictions: DataFrame, old: DataFrame, new: DataFrame, keys: Sequence[str], predicted: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """The same predictions counted right under an old and under a new truth."""
    joined = predictions.join(old.select(*keys, F.col(actual).alias("_old")), list(keys), "left").join(new.select(*keys, F.col(actual).alias("_new")), list(keys), "left")
    return joined.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(predicted).eqNullSafe(F.col("_old"))).alias("right_before"), F.count_if(F.col(predicted).eqNullSafe(F.col("_new"))).alias("right_now"))


def single_substitutions(df: DataFrame, missing: Column, extra: Column) -> DataFrame:
    """Frequencies of (missing, extra) over rows with exactly one of each."""
    rows = df.select(missing.alias("_m"), extra.alias("_e")).filter((F.size("_m") == 1) & (F.size("_e") == 1))
    return rows.groupBy(F.col("_m")[0].alias("missing"), F.col("_e")[0].alias("extra")).agg(F.count("*").alias("n"))


def conditioned_correct(predicted: Column, n: Column, truth: Column) -> Column:
    """Correct predictions of a unit: the positive ones if its truth is, else the others."""
    return F.when(truth, predicted).otherwise(n - predicted)


def mean_matrix(pairs: DataFrame, left: str, right: str, value: str, domain: Sequence[object]) -> DataFrame:
    """Mean value between any two groups: a row and a column for each, symmetric."""
    both = pairs.select(F.explode(F.array(F.struct(F.col(left).alias("a"), F.col(right).alias("b"), F.col(value).alias("v")), F.struct(F.col(right).alias("a"), F.col(left).alias("b"), F.col(value).alias("v")))).alias("e")).select("e.*")
    return both.groupBy(F.col("a").alias("group")).agg(*(F.avg(F.when(F.col("b") == d, F.col("v"))).alias(f"with_{d}") for d in domain))


def same_order(df: DataFrame, by: Sequence[str], first: str, second: str, name: str) -> DataFrame:
    """Whether two sort keys put each group's rows into one order (ties by name)."""
    order = lambda k: F.transform(F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), F.col(name).alias("n")))), lambda s: s["n"])
    return df.groupBy(*by).agg((order(first) == order(second)).alias("same_order"))


def post_move_check(gaps: DataFrame, moved: Column, removed: Column, by: Sequence[str], least: float = 5.0) -> DataFrame:
    """Clear if the object is gone, or moved and every gap is more than ``least``."""
    return gaps.groupBy(*by).agg(F.min("gap").alias("least_gap"), F.bool_or(removed).alias("removed"), F.bool_or(moved).alias("moved")).withColumn("clear", F.col("removed") | (F.col("moved") & (F.coalesce(F.col("least_gap"), F.lit(float("inf"))) > least)))


def action_masks(limits: DataFrame, step: float, most: float, by: Sequence[str] = ("scene_id",)) -> DataFrame:
    """The catalogue of distances in steps, and for each scene and direction which of them its limit allows."""
    n = round(most / step)
    grid = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i * step <= F.col("limit") + 1e-9)
    return limits.withColumn("allowed", grid).withColumns({"n_allowed": F.size(F.filter("allowed", lambda a: a)), "any_allowed": F.exists("allowed", lambda a: a)})


def ids_where(df: DataFrame, by: Sequence[str], name: str, queries: dict[str, Column]) -> DataFrame:
    """For each group and query the ids of the rows that satisfy it, in order (none: an empty array)."""
    return df.groupBy(*by).agg(*(F.array_sort(F.collect_list(F.when(rule, F.col(name)))).alias(q) for q, rule in queries.items()))


def action_validity(retrieves: Column, graspable_before: Column, removed: Column, full_after: Column, clear_after: Column, collides: Column, leaves: Column) -> Column:
    """Whether an executed action is valid: the target could be grasped and is gone, or another object moved and the target is whole and clear; without collision and within bounds."""
    path = ~F.coalesce(collides, F.lit(True)) & ~F.coalesce(leaves, F.lit(True))
    return path & F.coalesce(F.when(retrieves, graspable_before & removed).otherwise(full_after & clear_after), F.lit(False))


def renamed_join(tables: dict[str, tuple[DataFrame, dict[str, str]]], keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows that all tables have, side by side, where each table has its own names for the keys and columns (its name -> ours)."""
    ours = {name: df.withColumnsRenamed(names) for name, (df, names) in tables.items()}
    return side_by_side(ours, keys, dict.fromkeys(ours, columns))


def column_or_nested(df: DataFrame, name: str, nested: str) -> Column:
    """df's column of that name, or the field of a nested struct where df has no such column."""
    return F.col(f"`{name}`") if name in df.columns else F.col(f"`{nested}`").getField(name)
