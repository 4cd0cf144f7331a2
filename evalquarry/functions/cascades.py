"""First-match classifiers of failed responses: the order of the rules is what they mean.

Each takes Boolean columns, of which null counts as false, and gives the label of
the first rule that holds. The labels are fixed values of the result files.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binning import first_match


def _not(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def listing_error(valid: Column, exact: Column, twice: Column, missing: Column, extra: Column) -> Column:
    """A list of ids against the expected multiset."""
    rules = [(_not(valid), "parse_failure"), (exact, "correct"), (twice, "duplicate_output"), (missing & extra, "missing_and_extra"), (missing, "missing_only"), (extra, "extra_only")]
    return first_match(rules, "other_content_error")


def inventory_error(valid: Column, ids_exact: Column, all_exact: Column, objects_exact: Column, colours_exact: Column) -> Column:
    """An inventory of objects and colours; what isn't covered isn't compared."""
    rules = [(_not(valid), "parse_failure"), (_not(ids_exact), "id_coverage_failure"), (all_exact, "correct"), (objects_exact, "color_error_only"), (colours_exact, "object_error_only")]
    return first_match(rules, "object_and_color_error")


def request_error(valid: Column, exact: Column, request: Column, ids_exact: Column, rule_holds: Column, sums_up: Column, type_seen_wrong: Column, basic_colour_seen_wrong: Column, colour_seen_wrong: Column, type_flag_wrong: Column, colour_flag_wrong: Column) -> Column:
    """A request answered over an inventory: the first step of the reasoning that fails, what is seen ahead of what is compared."""
    return first_match(
        [
            (_not(valid), "parse_failure"),
            (exact, "correct"),
            (_not(request), "request_decomposition_failure"),
            (_not(ids_exact), "instance_enumeration_failure"),
            (_not(rule_holds), "truth_table_violation"),
            (_not(sums_up), "aggregation_failure"),
            (type_seen_wrong & basic_colour_seen_wrong, "joint_object_color_recognition_failure"),
            (type_seen_wrong, "object_recognition_failure"),
            (basic_colour_seen_wrong, "basic_color_recognition_failure"),
            (colour_seen_wrong, "canonical_color_disagreement"),
            (type_flag_wrong & colour_flag_wrong, "joint_type_color_comparison_failure"),
            (type_flag_wrong, "object_type_comparison_failure"),
            (colour_flag_wrong, "color_comparison_failure"),
        ],
        "unattributed_target_failure",
    )


def scaffold_error(valid: Column, exact: Column, request: Column, rule_holds: Column, types_exact: Column, inventory_exact: Column) -> Column:
    """The same with the constraints spelled out in the answer."""
    return first_match(
        [
            (_not(valid), "parse_failure"),
            (exact, "correct"),
            (_not(request), "request_decomposition_failure"),
            (_not(rule_holds), "truth_table_violation"),
            (_not(types_exact), "object_type_comparison_failure"),
            (inventory_exact, "gt_target_set_disagreement_with_semantic_inventory_exact"),
        ],
        "target_failure_with_semantic_error",
    )


def order_error(valid: Column, visible: Column, permutation: Column, exact: Column) -> Column:
    """An order of the visible ids."""
    rules = [(_not(valid), "parse_failure"), (_not(visible), "visible_ids_failure"), (_not(permutation), "output_permutation_failure"), (_not(exact), "spatial_order_failure")]
    return first_match(rules, "correct")


def pairs_error(valid: Column, visible: Column, complete: Column, exact: Column) -> Column:
    """All pairs of the visible ids."""
    rules = [(_not(valid), "parse_failure"), (_not(visible), "visible_ids_failure"), (_not(complete), "pairwise_structure_failure"), (_not(exact), "pairwise_relation_failure")]
    return first_match(rules, "correct")


def anchor_error(valid: Column, visible: Column, target: Column, complete: Column, exact: Column) -> Column:
    """The other ids' relations to one target."""
    rules = [(_not(valid), "parse_failure"), (_not(visible), "visible_ids_failure"), (_not(target), "target_id_failure"), (_not(complete), "relation_structure_failure"), (_not(exact), "target_relation_failure")]
    return first_match(rules, "correct")


def blocker_set_error(expected: Column, given: Column) -> Column:
    """A set of blockers (arrays; null is empty) against the expected one."""
    none = F.array().cast("array<bigint>")
    e, g = (F.filter(F.coalesce(x, none), lambda v: v.isNotNull()) for x in (expected, given))
    same = (F.size(F.array_except(e, g)) == 0) & (F.size(F.array_except(g, e)) == 0)
    rules = [(same, "set_exact"), (F.size(e) == 0, "false_positive_ids"), (F.size(g) == 0, "missed_all_ids"), (~F.arrays_overlap(e, g), "wrong_replacement_ids")]
    return first_match(rules, "partial_or_extra_ids")


def blocker_error(valid_ids: Column, given: Column) -> Column:
    """One blocker against those that count as right (an empty array: none should be named); null for a right one."""
    right = F.when(F.size(valid_ids) == 0, given.isNull()).otherwise(F.coalesce(F.array_contains(valid_ids, given), F.lit(False)))
    return F.when(~right, first_match([(F.size(valid_ids) == 0, "false_positive"), (given.isNull(), "null_miss")], "wrong_id"))


def action_error(valid: Column, checked: Column, action: Column, chosen: Column, direction: Column, distance: Column) -> Column:
    """An executed action: the first part that differs from the truth. direction and distance may be null (not comparable), which is no difference."""
    wrong = lambda c: c.eqNullSafe(F.lit(False))
    rules = [(valid, "SUCCESS"), (_not(checked), "PRECHECK_ERROR"), (_not(action), "ACTION_WRONG"), (_not(chosen), "OBJECT_WRONG"), (wrong(direction), "DIRECTION_WRONG"), (wrong(distance), "DISTANCE_WRONG")]
    return first_match(rules, "PHYSICAL_FAILURE_AFTER_GT_MATCH")


def blocking_reason(occluded: Column, too_near: Column) -> Column:
    """Why an object can't be taken at once: something hides part of it, stands within its clearance, or both."""
    hidden, crowded = F.coalesce(occluded, F.lit(False)), F.coalesce(too_near, F.lit(False))
    return first_match([(hidden & crowded, "BOTH"), (hidden, "OCCLUSION"), (crowded, "CLEARANCE_OVERLAP")], "NONE")
