"""Grouped metrics: rates, confusion, micro scores, stability, distributions, errors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate(flag: Column) -> Column:
    """Share of rows for which the flag is true, null counting as false; null without rows."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("int"))


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def percentage(a: Column, b: Column, digits: int = 3, empty: float | None = None) -> Column:
    return F.bround(ratio(a, b, empty) * 100, digits)


def binary_metric(df: DataFrame, truth: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and what follows from them; a rate without denominator is null."""
    counts = df.groupBy(*by).agg(
        F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"),
        F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumns({"n": tp + fp + fn + tn, "accuracy": ratio(tp + tn, tp + fp + fn + tn), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "precision": ratio(tp, tp + fp)})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))
    return out.withColumns({"balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2, "f1": F.coalesce(f1, F.lit(0.0))})


def presence_metric(df: DataFrame, truth: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """A nullable id against the truth: presence precision and recall, exact ids, wrong ids."""
    t, p = truth.isNotNull(), predicted.isNotNull()
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(truth.eqNullSafe(predicted)).alias("exact"), F.count_if(t & p).alias("both_present"),
        F.count_if(t & p & (truth != predicted)).alias("wrong_id"), F.count_if(t & ~p).alias("missed"), F.count_if(~t & p).alias("invented"), F.count_if(~t & ~p).alias("both_null"),
    )
    return out.withColumns({"presence_precision": ratio(F.col("both_present"), F.col("both_present") + F.col("invented")), "presence_recall": ratio(F.col("both_present"), F.col("both_present") + F.col("missed"))})


EMPTY_RULES = ("zero", "one_if_expected", "one_if_nothing_expected", "null")


def micro_scores(df: DataFrame, tp: Column, fp: Column, fn: Column, by: Sequence[str] = (), empty: str = "zero") -> DataFrame:
    """Micro precision, recall and F1 from summed counts.

    empty: the precision when nothing was predicted: 0; 1 if something was expected
    and null otherwise; 1 if nothing was expected and 0 otherwise; or null.
    """
    if empty not in EMPTY_RULES:
        raise ValueError(f"empty is one of {EMPTY_RULES}")
    out = df.groupBy(*by).agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))
    t, p, n = F.col("tp"), F.col("fp"), F.col("fn")
    none = {"zero": F.lit(0.0), "one_if_expected": F.when(t + n > 0, 1.0), "one_if_nothing_expected": (t + n == 0).cast("double"), "null": F.lit(None).cast("double")}[empty]
    out = out.withColumns({"precision": F.coalesce(ratio(t, t + p), none), "recall": F.coalesce(ratio(t, t + n), F.lit(0.0) if empty == "zero" else F.lit(None).cast("double"))})
    return out.withColumn("f1", F.coalesce(ratio(2 * t, F.nullif(2 * t + p + n, F.lit(0))), F.lit(0.0)))


def confusion(df: DataFrame, truth: str, predicted: str, domain: Sequence[object], prefix: str = "pred_") -> DataFrame:
    """A row for each label of the domain with a count for each predicted label; zeros stay."""
    wide = df.filter(F.col(truth).isin(*domain)).groupBy(truth).agg(*(F.count_if(F.col(predicted) == d).alias(f"{prefix}{d}") for d in domain))
    labels = df.sparkSession.createDataFrame([(d,) for d in domain], f"{truth} {df.schema[truth].dataType.simpleString()}")
    return labels.join(wide, truth, "left").na.fill(0, [f"{prefix}{d}" for d in domain])


def wide_metrics(df: DataFrame, by: Sequence[str], over: str, domain: Sequence[object], flag: Column) -> DataFrame:
    """n, correct and accuracy of each label of the domain, side by side."""
    out = []
    for d in domain:
        own = F.col(over) == d
        out += [F.count_if(own).alias(f"{d}_n"), F.count_if(own & flag).alias(f"{d}_correct"), F.avg(F.when(own, flag.cast("int"))).alias(f"{d}_accuracy")]
    return df.groupBy(*by).agg(*out)


def grouped_levels(df: DataFrame, sets: Sequence[Sequence[str]], *aggs: Column) -> DataFrame:
    """Several levels of grouping in one pass, with ``scope`` naming each row's level ("overall" for none)."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    out = df.groupingSets([[F.col(k) for k in s] for s in sets], *map(F.col, keys)).agg(*aggs, *(F.grouping(k).alias(f"_{k}") for k in keys))
    scope = F.concat_ws(" x ", *(F.when(F.col(f"_{k}") == 0, F.lit(k)) for k in keys))
    return out.withColumn("scope", F.when(scope == "", "overall").otherwise(scope)).drop(*(f"_{k}" for k in keys))


def main_effects(df: DataFrame, factors: Sequence[str], *aggs: Column) -> DataFrame:
    """Marginals of each factor: (factor, value, ...)."""
    out = grouped_levels(df, [[f] for f in factors], *aggs)
    return out.select(F.col("scope").alias("factor"), F.coalesce(*(F.col(f).cast("string") for f in factors)).alias("value"), *(c for c in out.columns if c not in (*factors, "scope")))


def stability(df: DataFrame, unit: Sequence[str], flag: Column, k: int, by: Sequence[str] = (), need_size: bool = True) -> DataFrame:
    """Units whose k repeats are all, some or none correct. need_size: units of other sizes are in no class."""
    each = df.groupBy(*dict.fromkeys([*by, *unit])).agg(F.count("*").alias("_n"), F.count_if(flag).alias("_c"))
    fits = (F.col("_n") == k) if need_size else F.lit(True)
    c, n = F.col("_c"), F.col("_n")
    return each.groupBy(*by).agg(F.count("*").alias("units"), F.count_if(fits & (c == n)).alias("all"), F.count_if(fits & (c > 0) & (c < n)).alias("some"), F.count_if(fits & (c == 0)).alias("none"))


def success_histogram(df: DataFrame, unit: Sequence[str], flag: Column, by: Sequence[str] = ()) -> DataFrame:
    """How many units have how many successes."""
    each = df.groupBy(*dict.fromkeys([*by, *unit])).agg(F.count_if(flag).alias("successes"))
    return each.groupBy(*by, "successes").agg(F.count("*").alias("units"))


def unanimity(df: DataFrame, unit: Sequence[str], value: Column) -> DataFrame:
    """For each unit: n, distinct values (null is one), and whether there is one only."""
    seen = F.count_distinct(F.struct(value.alias("v")))
    return df.groupBy(*unit).agg(F.count("*").alias("n"), seen.alias("distinct_values"), (seen == 1).alias("unanimous"))


def majority(df: DataFrame, unit: Sequence[str], value: str, order: Column) -> DataFrame:
    """The most frequent value of each unit; of equals the one met first in the order."""
    counts = df.groupBy(*unit, value).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    top = F.row_number().over(Window.partitionBy(*unit).orderBy(F.desc("votes"), "_first", value))
    return counts.withColumn("_r", top).filter("_r = 1").select(*unit, F.col(value).alias("majority"), "votes")


def describe(df: DataFrame, value: Column, by: Sequence[str] = (), sample: bool = False) -> DataFrame:
    """n, mean, median, min, max and sd: the population's, or the sample's (0 for one row)."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0)) if sample else F.stddev_pop(value)
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), sd.alias("sd"))


#: Ranges of values that percentiles tells apart; a group's task holds at most about so large a part of all different values.
RANGES = 64


def percentiles(df: DataFrame, value: Column, at: Sequence[float], by: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """Exact percentiles with linear interpolation, a column p<percent> each, of groups of any size.

    Equal values are counted first. Splitters, near the quantiles of all different
    values, cut them into ranges; the counts by group and range (at most ``ranges``
    rows a group) say in which range a wanted rank lies. Only those ranges are sorted,
    each by itself. Nulls take no part; a group of nulls alone has null percentiles.
    """
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))] or ["_all"]
    counted = df.select(*(keys or [F.lit(0).alias("_all")]), value.alias("_value")).groupBy(*names, "_value").agg(F.count("*").alias("_n"))
    counted = counted.withColumn("_n", F.when(F.col("_value").isNotNull(), F.col("_n")).otherwise(0))
    splits = counted.agg(F.percentile_approx("_value", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("_splits"))  # one row
    dealt = counted.filter("_n > 0").crossJoin(F.broadcast(splits)).withColumn("_range", F.size(F.filter("_splits", lambda s: s < F.col("_value")))).drop("_splits")
    sizes = dealt.groupBy(*names, "_range").agg(F.sum("_n").alias("_size"))
    so_far = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_size").over(so_far), F.lit(0)), "_total": F.sum("_size").over(Window.partitionBy(*names))})
    spots = [(F.col("_total") - 1) * F.lit(float(p)) for p in at]
    ranks = [f(spot).cast("long") for spot in spots for f in (F.floor, F.ceil)]
    within = lambda rank, start, n: (rank >= start) & (rank < start + n)
    wanted = sizes.filter(reduce(Column.__or__, (within(r, F.col("_before"), F.col("_size")) for r in ranks)))
    same = reduce(Column.__and__, (F.col(f"d.{c}").eqNullSafe(F.col(f"w.{c}")) for c in [*names, "_range"]))
    rows = dealt.alias("d").join(wanted.alias("w"), same).select(*(F.col(f"d.{c}") for c in [*names, "_range", "_value", "_n"]), "_before", "_total")
    sooner = Window.partitionBy(*names, "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_n").over(sooner), F.lit(0)))
    found = placed.groupBy(*names).agg(F.first("_total").alias("_total"), F.array(*(F.max(F.when(within(r, F.col("_start"), F.col("_n")), F.col("_value"))) for r in ranks)).alias("_v"))
    low, high = (lambda i: F.col("_v")[2 * i].cast("double")), (lambda i: F.col("_v")[2 * i + 1].cast("double"))
    share = lambda i: spots[i] - F.floor(spots[i])
    out = found.select(*names, *(F.when(share(i) == 0, low(i)).otherwise(low(i) * (1 - share(i)) + high(i) * share(i)).alias(f"p{p * 100:g}".replace(".", "_")) for i, p in enumerate(at)))
    groups = counted.groupBy(*names).agg(F.lit(1).alias("_one")) if by else df.sparkSession.range(1).select(F.lit(0).alias("_all"))
    same = reduce(Column.__and__, (F.col(f"g.{c}").eqNullSafe(F.col(f"o.{c}")) for c in names))
    return groups.alias("g").join(out.alias("o"), same, "left").select(*(F.col(f"g._k{i}").alias(c) for i, c in enumerate(by)), *(F.col(f"o.{c}") for c in out.columns if c not in names))


def distribution(df: DataFrame, label: Column, domain: Sequence[str], by: Sequence[str] = (), positive: str | None = None) -> DataFrame:
    """n, a count for each label, INVALID for all else, and the positive label's share."""
    out = [F.count("*").alias("n"), *(F.count_if(label == d).alias(d) for d in domain), F.count_if(~F.coalesce(label.isin(*domain), F.lit(False))).alias("INVALID")]
    if positive:
        out.append(rate(label == positive).alias("positive_rate"))
    return df.groupBy(*by).agg(*out)


def frequencies(df: DataFrame, *values: Column) -> DataFrame:
    return df.groupBy(*values).agg(F.count("*").alias("n"))


def array_frequencies(df: DataFrame, array: Column, name: str = "value") -> DataFrame:
    return df.select(F.explode(array).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def constant_baseline(train: DataFrame, test: DataFrame, label: str, value: str) -> DataFrame:
    """The train rows' most frequent label (ties: the least) and mean value, scored on the test rows: one row."""
    top = train.groupBy(label).agg(F.count("*").alias("_c")).agg(F.min(F.struct((-F.col("_c")).alias("c"), F.col(label).alias("l"))).alias("m")).select(F.col("m.l").alias("constant_label"))
    mean = train.agg(F.avg(value).alias("constant_value"))
    fixed = top.crossJoin(mean)  # one row each
    return test.crossJoin(F.broadcast(fixed)).groupBy("constant_label", "constant_value").agg(F.count("*").alias("n"), rate(F.col(label) == F.col("constant_label")).alias("label_accuracy"), F.avg(F.abs(F.col(value) - F.col("constant_value"))).alias("value_mae"))


def regression_errors(df: DataFrame, predicted: Column, target: Column, by: Sequence[str] = ()) -> DataFrame:
    e = predicted - target
    return df.groupBy(*by).agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("worst"))


def interval_hits(df: DataFrame, predicted: Column, low: Column, high: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of predictions inside their interval, and how far the others are off on average over all."""
    off = F.greatest(low - predicted, predicted - high, F.lit(0.0))
    return df.groupBy(*by).agg(F.count("*").alias("n"), rate(off == 0).alias("hit_rate"), F.avg(off).alias("violation"))


def conditional_rate(df: DataFrame, population: Column, flag: Column, by: Sequence[str] = (), empty: float | None = None) -> DataFrame:
    """The flag's rate within a part of the rows; what an empty part has is a choice."""
    out = F.avg(F.when(population, flag.cast("int")))
    return df.groupBy(*by).agg(F.count_if(population).alias("population"), (out if empty is None else F.coalesce(out, F.lit(empty))).alias("rate"))


def rescored(versions: dict[str, DataFrame], truth: DataFrame, key: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Several versions' predictions under one truth: their binary metrics by version."""
    union = None
    for name, df in versions.items():
        part = df.select(*key, F.col(predicted).alias("_p"), F.lit(name).alias("version"))
        union = part if union is None else union.unionByName(part)
    return binary_metric(union.join(truth.select(*key, F.col(actual).alias("_t")), list(key)), F.col("_t"), F.col("_p"), ["version"])


def first_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def best_row(df: DataFrame, by: Sequence[str], score: Sequence[Column]) -> DataFrame:
    """The row of each group with the greatest tuple of scores."""
    whole = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(*by).agg(F.max_by(whole, F.struct(*(s.alias(f"s{i}") for i, s in enumerate(score)))).alias("_w")).select("_w.*")


def flag_counts(df: DataFrame, flags: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """For each flag how many rows have it false; null (what can't be compared) is neither true nor false."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(flag.eqNullSafe(F.lit(False))).alias(name) for name, flag in flags.items()))


def rounded_delta(df: DataFrame, before: Column, after: Column, by: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """Both rates as rounded percentages, and the difference of these, rounded again: what a reader of the two would compute."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(before).alias("_b"), F.count_if(after).alias("_a"))
    out = out.withColumns({"before_pct": percentage(F.col("_b"), F.col("n"), digits), "after_pct": percentage(F.col("_a"), F.col("n"), digits)})
    return out.withColumn("delta_pp", F.bround(F.col("after_pct") - F.col("before_pct"), digits)).drop("_b", "_a")
