"""Step functions and first-match classifiers as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps(value: Column, bounds: Sequence[tuple[float, str]], above: str, inclusive: bool = True) -> Column:
    """The label of the first bound that value is at most (below, if not inclusive); above otherwise. Null stays null."""
    out = F.when(value.isNull(), F.lit(None))
    for bound, label in bounds:
        out = out.when(value <= bound if inclusive else value < bound, label)
    return out.otherwise(above)


def translation_level(cm: Column) -> Column:
    return steps(cm, [(0, "NONE"), (5, "SHORT"), (10, "MEDIUM")], "LONG")


def free_space_level(cm: Column) -> Column:
    return steps(cm, [(0, "OCCUPIED"), (5, "TIGHT"), (10, "LIMITED")], "OPEN")


def rotation_level(degrees: Column) -> Column:
    return steps(degrees, [(0, "NONE"), (15, "SMALL"), (45, "MEDIUM")], "LARGE")


def distance_bin(cm: Column) -> Column:
    """Left-closed bins: short [2, 5), medium [5, 9), long [9, 25.1); null outside."""
    return F.when((cm >= 2) & (cm < 5), "short").when((cm >= 5) & (cm < 9), "medium").when((cm >= 9) & (cm < 25.1), "long")


def first_match(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds; a null rule doesn't."""
    out = None
    for rule, label in rules:
        out = F.when(rule, label) if out is None else out.when(rule, label)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def prefix_class(value: Column, prefixes: dict[str, str], strict: bool = True) -> Column:
    """The class of the prefix that value has; without one an error, or null if not strict."""
    failure = F.raise_error(F.concat(F.lit("no class for "), F.coalesce(value, F.lit("null")))).cast("string") if strict else F.lit(None).cast("string")
    out = None
    for prefix, label in prefixes.items():
        out = F.when(value.startswith(prefix), label) if out is None else out.when(value.startswith(prefix), label)
    return out.otherwise(failure)


def joint(a: Column, b: Column, both: str = "both", a_only: str = "a_only", b_only: str = "b_only", neither: str = "neither") -> Column:
    """The cell of a 2 x 2 table; null counts as false."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return F.when(a & b, both).when(a, a_only).when(b, b_only).otherwise(neither)


def guarded_label(value: Column, domain: Sequence[str], valid: Column | None = None, invalid: str = "INVALID") -> Column:
    """value if it is in the domain and its row valid; invalid otherwise, null included."""
    good = value.isin(*domain) & (valid if valid is not None else F.lit(True))
    return F.when(good, value).otherwise(invalid)


def remap(value: Column, table: dict[str, str], default: str = "INVALID") -> Column:
    out = None
    for a, b in table.items():
        out = F.when(value == a, b) if out is None else out.when(value == a, b)
    return out.otherwise(default)


def condition_key(condition: Column, resolution: Column) -> Column:
    """condition, or condition_resolution where the resolution isn't null."""
    return F.when(resolution.isNull(), condition).otherwise(F.concat_ws("_", condition, resolution))


def side_class(sides: Column) -> Column:
    """all_left (an empty array too), all_right, or mixed."""
    return F.when(F.forall(sides, lambda s: s == "left"), "all_left").when(F.forall(sides, lambda s: s == "right"), "all_right").otherwise("mixed")


def outcome_bucket(correct: Column, total: Column) -> Column:
    return F.when(correct == total, "all_correct").when(correct == 0, "all_wrong").otherwise("mixed")


def violations(rules: dict[str, Column]) -> Column:
    """Messages of the rules that are broken, as an array; a rule that is null is broken."""
    each = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(message)) for message, rule in rules.items()]
    return F.filter(F.array(*each), lambda m: m.isNotNull())


def within(ranges: dict[str, tuple[float, float]]) -> Column:
    """Whether each named column lies in its closed range; a null doesn't."""
    out = F.lit(True)
    for name, (low, high) in ranges.items():
        out = out & F.coalesce(F.col(name).between(low, high), F.lit(False))
    return out


#: Which views of a scene are accepted, and which are visible enough to keep.
ACCEPTED = {"visible_target_fraction": (0.50, 0.75), "blocker_occlusion_fraction": (0.25, 0.50)}
VISIBLE_ENOUGH = {"visible_target_fraction": (0.40, 0.80), "blocker_occlusion_fraction": (0.20, 0.60), "other_occlusion_fraction": (float("-inf"), 0.10)}
