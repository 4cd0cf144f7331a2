"""Set, multiset, order and map logic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def set_scores(expected: Column, predicted: Column) -> Column:
    """struct(tp, fp, fn, exact) of two arrays as sets; null is an empty set."""
    e, p = (F.array_distinct(F.coalesce(x, F.array().cast("array<bigint>"))) for x in (expected, predicted))
    tp = F.size(F.array_intersect(e, p))
    return F.struct(tp.alias("tp"), (F.size(p) - tp).alias("fp"), (F.size(e) - tp).alias("fn"), ((F.size(e) == tp) & (F.size(p) == tp)).alias("exact"))


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def multiplicity(a: Column, x: Column) -> Column:
    return F.size(F.filter(a, lambda y: y == x))


def multiset_minus(a: Column, b: Column) -> Column:
    """a without as many of each value as b has, in order of value."""
    rest = F.transform(F.array_sort(F.array_distinct(a)), lambda x: F.array_repeat(x, F.greatest(multiplicity(a, x) - multiplicity(b, x), F.lit(0))))
    return F.flatten(rest)


def multiset_scores(expected: Column, predicted: Column) -> Column:
    """struct(tp, fp, fn, missing, extra) with multiplicity."""
    missing, extra = multiset_minus(expected, predicted), multiset_minus(predicted, expected)
    return F.struct((F.size(expected) - F.size(missing)).alias("tp"), F.size(extra).alias("fp"), F.size(missing).alias("fn"), missing.alias("missing"), extra.alias("extra"))


def pairs_in_order(order: Column) -> Column:
    """All (i, j) positions' elements with i < j, as structs (a, b)."""
    n = F.size(order)
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i < n)
    return F.flatten(F.transform(at, lambda i: F.transform(F.slice(order, i + 1, n), lambda b: F.struct(F.element_at(order, i).alias("a"), b.alias("b")))))


def order_agreement(expected: Column, predicted: Column) -> Column:
    """struct(agree, total): pairs of the expected order that the predicted one has in the same order; what it lacks is wrong."""
    pairs = pairs_in_order(expected)
    agree = F.filter(pairs, lambda p: (F.array_position(predicted, p["a"]) > 0) & (F.array_position(predicted, p["a"]) < F.array_position(predicted, p["b"])))
    return F.struct(F.size(agree).alias("agree"), F.size(pairs).alias("total"))


def is_permutation(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def sorted_unique(a: Column) -> Column:
    return a == F.array_sort(F.array_distinct(a))


def sparse_ids(a: Column) -> Column:
    """Whether no two of the ids differ by less than 2."""
    s = F.array_sort(a)
    gaps = F.zip_with(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda x, y: x - y)
    return ~F.exists(gaps, lambda g: g <= 1)


def relations(order: Column, anchor: Column) -> Column:
    """struct(front, behind) of the anchor in an order; null if it lacks the anchor."""
    at = F.array_position(order, anchor).cast("int")
    return F.when(at > 0, F.struct(F.slice(order, 1, at - 1).alias("front"), F.slice(order, at + 1, F.size(order)).alias("behind")))


def relation_agreement(expected: Column, predicted: Column, anchor: Column) -> Column:
    """struct(agree, total): elements on the same side of the anchor in both orders; what is missing is not counted as agreeing."""
    others = F.filter(expected, lambda x: x != anchor)
    e, p = F.array_position(expected, anchor), F.array_position(predicted, anchor)
    same = lambda x: (p > 0) & (F.array_position(predicted, x) > 0) & ((F.array_position(expected, x) < e) == (F.array_position(predicted, x) < p))
    return F.struct(F.size(F.filter(others, same)).alias("agree"), F.size(others).alias("total"))


def map_agreement(a: Column, b: Column) -> Column:
    """struct(agree, total): keys of a for which b has an equal value."""
    keys = F.map_keys(a)
    return F.struct(F.size(F.filter(keys, lambda k: F.element_at(a, k).eqNullSafe(F.try_element_at(b, k)) & F.map_contains_key(b, k))).alias("agree"), F.size(keys).alias("total"))


def maps_equal(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))


def ids_by(items: Column, key: str, value: str) -> Column:
    """value of an array's structs in the order of (key, value)."""
    return F.transform(F.array_sort(F.transform(items, lambda s: F.struct(s[key].alias("k"), s[value].alias("v")))), lambda s: s["v"])


def nearest_item(items: Column, by: str, name: str) -> Column:
    """name of the struct with the least ``by`` (ties: least name)."""
    return F.array_min(F.transform(items, lambda s: F.struct(s[by].alias("k"), s[name].alias("v"))))["v"]


def expand_null(value: Column, domain: list[str]) -> Column:
    """An array to explode: the whole domain where value is null, value alone elsewhere."""
    return F.when(value.isNull(), F.array(*map(F.lit, domain))).otherwise(F.array(value))


def query_rule(color_query: Column, type_query: Column, color_flag: Column, type_flag: Column, match: Column) -> Column:
    """Whether an instance's flags obey the query's shape.

    A colour-only query needs a null type flag and match = colour flag, a type-only
    query the mirror image, and a query of both needs both flags and match = AND.
    """
    colour = type_flag.isNull() & color_flag.isNotNull() & match.eqNullSafe(color_flag)
    kind = color_flag.isNull() & type_flag.isNotNull() & match.eqNullSafe(type_flag)
    both = color_flag.isNotNull() & type_flag.isNotNull() & match.eqNullSafe(color_flag & type_flag)
    return F.when(color_query & ~type_query, colour).when(type_query & ~color_query, kind).when(color_query & type_query, both).otherwise(False)


def last_of_key(items: Column, key: str) -> Column:
    """An array's structs without those whose key comes again further on, and without null keys."""
    return F.filter(items, lambda x, i: x[key].isNotNull() & ~F.exists(F.slice(items, i + 2, F.size(items)), lambda y: y[key].eqNullSafe(x[key])))


def first_of_key(items: Column, key: str) -> Column:
    """An array's structs without those whose key stood before, and without null keys."""
    return F.filter(items, lambda x, i: x[key].isNotNull() & ~F.exists(F.slice(items, F.lit(1), i), lambda y: y[key].eqNullSafe(x[key])))


def map_by(items: Column, key: str, value: str) -> Column:
    """A map from an array's structs; of equal keys the last one counts."""
    return F.map_from_entries(F.transform(last_of_key(items, key), lambda x: F.struct(x[key].alias("k"), x[value].alias("v"))))


def others(items: Column, key: str, target: Column) -> Column:
    """An array's structs but the target's: candidate rows, to be exploded."""
    return F.filter(items, lambda x: ~x[key].eqNullSafe(target))


def shown_ids(items: Column, ids: Column, by: str, name: str) -> Column:
    """struct(order, complete): the structs whose name is in ids, as names in order of ``by``; complete if those are all of ids, each once."""
    order = ids_by(F.filter(items, lambda s: F.array_contains(ids, s[name])), by, name)
    return F.struct(order.alias("order"), (F.array_sort(order) == F.array_sort(ids)).alias("complete"))


def restricted(ids: Column, visible: Column, reason: Column, none: str = "NONE") -> Column:
    """struct(ids, holds): the visible ones in order, and whether the reason is "none" just if there are none."""
    left = F.array_sort(F.array_intersect(ids, visible))
    return F.struct(left.alias("ids"), ((reason == none) == (F.size(left) == 0)).alias("holds"))


def pair_map(pairs: Column, ids: Column) -> Column:
    """Pairs (structs id_a, id_b, front_id) that say of two ids which is in front, checked against all pairs of ids.

    struct(fronts, errors, twice, complete): a map from "a-b" to the front id, of
    equal pairs the first; how many pairs aren't in canonical order, are of other
    ids, name a third one or hold a null; how many stand again; and whether each
    pair of ids stands exactly once and nothing else does.
    """
    a, b, front = (lambda p: p["id_a"]), (lambda p: p["id_b"]), (lambda p: p["front_id"])
    fine = lambda p: F.coalesce((a(p) < b(p)) & F.array_contains(ids, a(p)) & F.array_contains(ids, b(p)) & ((front(p) == a(p)) | (front(p) == b(p))), F.lit(False))
    good = F.transform(F.filter(pairs, fine), lambda p: F.struct(F.concat_ws("-", a(p), b(p)).alias("k"), front(p).alias("v")))
    once = first_of_key(good, "k")
    n = F.size(ids)
    complete = (F.size(pairs) == F.size(once)) & (F.size(once) == (n * (n - 1) / 2))
    return F.struct(F.map_from_entries(once).alias("fronts"), (F.size(pairs) - F.size(good)).alias("errors"), (F.size(good) - F.size(once)).alias("twice"), complete.alias("complete"))


def relations_from_pairs(fronts: Column, ids: Column, target: Column) -> Column:
    """struct(front, behind) of a target from a map of pairs; an id whose pair is missing is on neither side."""
    key = lambda x: F.concat_ws("-", F.least(x, target), F.greatest(x, target))
    rest = F.filter(ids, lambda x: x != target)
    side = lambda who: F.filter(rest, lambda x: F.coalesce(F.try_element_at(fronts, key(x)) == who(x), F.lit(False)))
    return F.struct(side(lambda x: x).alias("front"), side(lambda x: target).alias("behind"))


def mask_counts(mask: Column) -> Column:
    """struct(allowed, first_half, second_half) of an array of Booleans: how many are true, and whether any is in either half."""
    half = F.floor(F.size(mask) / 2).cast("int")
    return F.struct(F.size(F.filter(mask, lambda m: m)).alias("allowed"), F.exists(F.slice(mask, F.lit(1), half), lambda m: m).alias("first_half"), F.exists(F.slice(mask, half + 1, F.size(mask)), lambda m: m).alias("second_half"))


def mirrored_mask(mask: Column) -> Column:
    """The mask of a mirrored scene: left and right halves change places. Twice is the mask itself."""
    half = F.floor(F.size(mask) / 2).cast("int")
    return F.concat(F.slice(mask, half + 1, F.size(mask)), F.slice(mask, F.lit(1), half))
