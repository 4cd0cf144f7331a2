"""Filter interaction audit: what each filter removes in each order, and its Shapley value, from polynomials over masks."""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import bound, split_words
from .shared import saved

FILTERS = "ABCDE"


def failures(text: Column) -> dict[str, Column]:
    """Whether a text that isn't null fails the filters that look at it alone."""
    words = split_words(text)
    counts = bound(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    return {
        "A": counts["n"] < 200,
        "B": counts["distinct"] * 100 < counts["n"] * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 3,
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }


def masked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail, filter k as bit k.

    Texts are read once, for a written row of numbers and a SHA-256 for each
    document. The smallest id of each text is an aggregation with map-side combine;
    it meets the rows on hash and id, so a text in a third of all rows is no hot key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = reduce(Column.__add__, (F.when(v, 1 << FILTERS.index(k)).otherwise(0) for k, v in failures(text).items()))
    keyed = saved(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), bits.alias("own"), F.unhex(F.sha2(text, 256)).alias("hash")), "masks")
    firsts = keyed.groupBy("hash").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    rows = keyed.join(firsts, ["hash", "id"], "left").join(marks, "id", "left").withColumn("mask", F.col("own") + copy)
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def by_subset(value: object) -> Column:
    """An array of value(t) for each subset t of the filters, as a number."""
    return F.transform(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)), value)


def removal_polynomials(counts: DataFrame, weights: tuple[str, ...] = ("n", "good", "toxic")) -> DataFrame:
    """Each part's multilinear removal polynomials: their coefficients c<w>, by the subset of filters as a number.

    A row with failing filters m stays with probability prod over k in m of
    (1 - x_k) if filter k is applied with probability x_k. One minus that,
    multiplied out, has the sign (-1)^(|T| + 1) before each non-empty subset T of
    m. So a subset's coefficient is that sign times the rows whose mask holds it.
    A part has a row for each mask, 32 at most.
    """

    def coefficients(w: str) -> Column:
        def one(t: Column) -> Column:
            sign = F.when(t == 0, 0).when(F.bit_count(t) % 2 == 1, 1).otherwise(-1)
            return total(F.transform(F.filter("masks", lambda r: r["mask"].bitwiseAND(t) == t), lambda r: r[w])) * sign

        return by_subset(one).alias(f"c{w}")

    masks = F.collect_list(F.struct("mask", *weights))
    return counts.groupBy("part").agg(masks.alias("masks"), F.sum("n").alias("total")).select("part", "total", *map(coefficients, weights))


def corners(coefficients: str) -> Column:
    """A polynomial's values where every filter is applied or not, by the subset that is: sums of the coefficients of its subsets."""
    return by_subset(lambda corner: total(F.filter(coefficients, lambda _, t: t.bitwiseAND(corner) == t)))


def shapley(coefficients: str, k: int, scale: int) -> Column:
    """``scale`` times the integral from 0 to 1 of the partial derivative for filter k along the diagonal.

    On the diagonal the derivative is the sum of c_T t^(|T| - 1) over the subsets T
    that hold k; each term integrates to c_T / |T|. Over the least common
    denominator all are whole numbers; ``scale`` is a multiple of it, as 120 is.
    """
    sizes = range(1, len(FILTERS) + 1)
    whole = lcm(*sizes)
    assert scale % whole == 0
    share = F.array(*(F.lit(whole // n) for n in sizes))
    terms = F.transform(coefficients, lambda c, t: F.when(t.bitwiseAND(1 << k) > 0, c * F.element_at(share, F.bit_count(t))).otherwise(0))
    return total(terms) * (scale // whole)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the five filters, and step of the order.

    kept and removed are differences of the removal polynomial's corners before and
    after the step; redundant, unique_fails, good_lost and toxic_lost likewise;
    shapley is 120 times the filter's Shapley value.

    A null text is an empty one, which fails A alone (and E, if an earlier id has
    one); a null part is the empty string. Of equal texts the smallest id passes E;
    repeated rows of that id all pass, as none is smaller, and a null id is neither
    smaller nor larger than any: it passes. An id with several labels counts as good
    or toxic if any says so. Other columns play no part, whatever their names; an
    empty table has no parts and so no rows.
    """
    size = len(FILTERS)
    orders = list(permutations(range(size)))
    rows = [{"filter_order": "".join(FILTERS[k] for k in order), "step": step + 1, "k": order[step], "before": sum(1 << k for k in order[:step])} for order in orders for step in range(size)]
    steps = F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, k: int, before: int>>")  # one literal: quick to plan
    solved = removal_polynomials(masked(docs, labels, id_col, text_col, part_col))
    solved = solved.select("part", "total", *(corners(f"c{w}").alias(w) for w in ("n", "good", "toxic")), F.array(*(shapley("cn", k, len(orders)) for k in range(size))).alias("values"))
    own = F.expr("shiftleft(1, k)")
    stepped = solved.withColumn("s", F.explode(steps)).select("*", "s.*").withColumn("after", F.col("before") + own)
    everything = (1 << size) - 1

    def lost(w: str) -> Column:
        return F.get(w, "after") - F.get(w, "before")

    return stepped.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get("n", "after")).alias("kept"),
        lost("n").alias("removed"),
        (F.get("n", own) - lost("n")).alias("redundant"),
        (F.get("n", F.lit(everything)) - F.get("n", F.lit(everything) - own)).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("values", "k").alias("shapley"),
    )
