"""What a parsed response must satisfy beyond its schema, as named rules over columns.

Each function returns rules for ``binning.violations``: a rule holds, or its name is
reported. Fields are columns of the parsed response; visible is the array of ids
that can be seen, target the id that is asked for. A null id is the answer "none".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binning import rotation_level, translation_level


def implies(a: Column, b: Column) -> Column:
    return ~F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def visibility_rules(found: Column, visibility: Column) -> dict[str, Column]:
    """A target that isn't found isn't visible, and the other way round."""
    return {"not found but visible": implies(~found, visibility == "NOT_VISIBLE"), "found but not visible": implies(found, visibility != "NOT_VISIBLE")}


def ordered_assessment_rules(ids: Column, flags: Column, shown: Column, target: Column, named_target: Column) -> dict[str, Column]:
    """One Boolean for each other object that is shown, in the order shown (left to right)."""
    others = F.filter(shown, lambda x: x != target)
    return {"names another target": named_target.eqNullSafe(target), "objects out of order, missing or extra": ids.eqNullSafe(others), "a flag is no Boolean": ~F.exists(flags, lambda f: f.isNull())}


def relation_rules(ids: Column, relations: Column, visible: Column, target: Column, named_target: Column, positive: str = "INTERFERES", negative: str = "DOES_NOT_INTERFERE") -> dict[str, Column]:
    """One relation for each visible object in ascending order; TARGET for the target alone."""
    pairs = F.arrays_zip(ids.alias("i"), relations.alias("r"))
    return {
        "names another target": named_target.eqNullSafe(target),
        "number of objects": F.size(ids) == F.size(visible),
        "an object twice": F.size(ids) == F.size(F.array_distinct(ids)),
        "other objects than the visible ones": F.array_sort(F.array_distinct(ids)) == F.array_sort(visible),
        "not ascending": ids == F.array_sort(ids),
        "the target has another relation": F.forall(pairs, lambda p: implies(p["i"] == target, p["r"] == "TARGET")),
        "another object's relation": F.forall(pairs, lambda p: implies(p["i"] != target, p["r"].isin(positive, negative))),
    }


def single_id_rules(chosen: Column, visible: Column, target: Column) -> dict[str, Column]:
    """An id that may be null, else is visible and not the target."""
    return {"chosen object isn't visible": chosen.isNull() | F.array_contains(visible, chosen), "chosen object is the target": chosen.isNull() | (chosen != target)}


def blocker_rules(reason: Column, blocker: Column, visible: Column, target: Column) -> dict[str, Column]:
    """A reason goes with a blocker, no reason with none."""
    return {"no reason but a blocker": implies(reason == "NONE", blocker.isNull()), "a reason but no blocker": implies(~reason.eqNullSafe(F.lit("NONE")), blocker.isNotNull()), **single_id_rules(blocker, visible, target)}


def blocker_set_rules(reason: Column, blockers: Column, visible: Column, target: Column) -> dict[str, Column]:
    """The same for an array of blockers: integers, ascending, each once."""
    given = F.coalesce(blockers, F.array().cast("array<bigint>"))
    return {
        "blockers are no array": blockers.isNotNull(),
        "a blocker is no integer": ~F.exists(given, lambda b: b.isNull()),
        "a blocker twice": F.size(given) == F.size(F.array_distinct(given)),
        "blockers not ascending": given == F.array_sort(given),
        "a blocker isn't visible": F.forall(given, lambda b: b.isNull() | F.array_contains(visible, b)),
        "a blocker is the target": ~F.exists(given, lambda b: b == target),
        "no reason but blockers": implies(reason == "NONE", F.size(given) == 0),
        "a reason but no blockers": implies(~reason.eqNullSafe(F.lit("NONE")), F.size(given) > 0),
    }


#: Actions of the last level. Fixed values.
MOVES = ("TRANSLATE", "ROTATE", "LIFT_AND_RELOCATE")


def action_rules(action: Column, chosen: Column, visible: Column, target: Column, distance: Column, distance_level: Column, angle: Column, angle_level: Column) -> dict[str, Column]:
    """Retrieve the target or move another visible object; levels fit their numbers."""
    return {
        "object isn't visible": chosen.isNull() | F.array_contains(visible, chosen),
        "retrieves another object": implies(action == "RETRIEVE", chosen == target),
        "moves the target": implies(action.isin(*MOVES), ~chosen.eqNullSafe(target)),
        "distance and its level differ": implies((action == "TRANSLATE") & distance.isNotNull(), translation_level(distance) == distance_level),
        "angle and its level differ": implies((action == "ROTATE") & angle.isNotNull(), rotation_level(angle) == angle_level),
    }


def upstream_rules(action: Column, chosen: Column, target: Column, reason: Column, blocker: Column) -> dict[str, Column]:
    """An action follows the blocker that an earlier level chose."""
    free = reason == "NONE"
    return {
        "nothing blocks but it doesn't retrieve": implies(free, (action == "RETRIEVE") & (chosen == target)),
        "retrieves in spite of a blocker": implies(~free, action != "RETRIEVE"),
        "moves another object than the blocker": implies(~free, chosen.eqNullSafe(blocker)),
    }


def action_only_rules(raw: Column, action: Column) -> dict[str, Column]:
    """An object with the action alone, one of four."""
    return {"other keys than action": F.json_object_keys(raw).eqNullSafe(F.array(F.lit("action"))), "unknown action": action.isin("RETRIEVE", *MOVES)}
