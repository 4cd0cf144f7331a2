"""Scenes as tables: pixels, points, rectangles and polygons of many scenes at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binning as B
from ..functions import geometry as G
from ..functions import planar as P
from .stable import checkpointed


def mask_summary(pixels: DataFrame, by: Sequence[str] = ("scene_id", "object_id")) -> DataFrame:
    """Area, centroid and bounding box of each mask of a pixel table (u, v)."""
    return pixels.groupBy(*by).agg(F.count("*").alias("area"), F.avg("u").alias("u_mean"), F.avg("v").alias("v_mean"), F.min("u").alias("u_min"), F.max("u").alias("u_max"), F.min("v").alias("v_min"), F.max("v").alias("v_max"))


def visibility(seen: DataFrame, alone: DataFrame, by: Sequence[str] = ("scene_id", "object_id")) -> DataFrame:
    """FULL, PARTIAL or NOT_VISIBLE from the pixels that are seen and those of the object alone, and the visible share."""
    k = [*by, "u", "v"]
    both = seen.select(*k, F.lit(1).alias("s")).join(alone.select(*k, F.lit(1).alias("a")), k, "full_outer")
    out = both.groupBy(*by).agg(F.count("s").alias("seen_area"), F.count("a").alias("full_area"), F.count_if(~F.col("s").eqNullSafe(F.col("a"))).alias("differing"))
    state = F.when(F.col("seen_area") == 0, "NOT_VISIBLE").when(F.col("differing") == 0, "FULL").otherwise("PARTIAL")
    return out.withColumns({"visibility": state, "visible_share": F.try_divide("seen_area", "full_area")})


def occluders(hidden: DataFrame, others: DataFrame, least: float = 0.05) -> DataFrame:
    """Objects on pixels that the target alone would have: overlap and its share of the target; the primary one has most (ties: least id).

    hidden: scene_id, u, v of the target alone; others: scene_id, object_id, u, v.
    """
    size = hidden.groupBy("scene_id").agg(F.count("*").alias("target_area"))
    met = hidden.join(others, ["scene_id", "u", "v"]).groupBy("scene_id", "object_id").agg(F.count("*").alias("overlap"))
    out = met.join(size, "scene_id").withColumn("share", F.col("overlap") / F.col("target_area")).filter(F.col("share") >= least)
    rank = F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("share"), "object_id"))
    return out.withColumn("is_primary", rank == 1)


def backproject(pixels: DataFrame, fx: float, fy: float, cx: float, cy: float, rotation: Sequence[Sequence[float]], shift: Sequence[float]) -> DataFrame:
    """x, y, z of pixels (u, v, depth) in the frame that rotation and shift lead to."""
    camera = [(F.col("u") - cx) / fx * F.col("depth"), (F.col("v") - cy) / fy * F.col("depth"), F.col("depth")]
    return pixels.withColumns({n: sum((camera[j] * F.lit(float(rotation[i][j])) for j in range(3)), F.lit(float(shift[i]))) for i, n in enumerate("xyz")})


def project(points: DataFrame, fx: float, fy: float, cx: float, cy: float, rotation: Sequence[Sequence[float]], shift: Sequence[float]) -> DataFrame:
    """u, v, depth of points (x, y, z): the inverse of backproject."""
    moved = [F.col(n) - F.lit(float(shift[i])) for i, n in enumerate("xyz")]
    camera = [sum((moved[i] * F.lit(float(rotation[i][j])) for i in range(3)), F.lit(0.0)) for j in range(3)]
    return points.withColumns({"u": camera[0] / camera[2] * fx + cx, "v": camera[1] / camera[2] * fy + cy, "depth": camera[2]})


def point_coverage(points: DataFrame, boxes: DataFrame, margin: float, by: Sequence[str] = ("scene_id", "object_id")) -> DataFrame:
    """Share of each object's points inside its box (struct box) widened by a margin, and of valid depths."""
    b = G.expanded(F.col("box"), margin)
    within = (F.col("x") >= b["xmin"]) & (F.col("x") <= b["xmax"]) & (F.col("y") >= b["ymin"]) & (F.col("y") <= b["ymax"])
    return points.join(boxes, list(by)).groupBy(*by).agg(F.count("*").alias("points"), F.avg(within.cast("int")).alias("inside_share"), F.avg((F.col("depth") > 0).cast("int")).alias("valid_share"))


def changed_pixels(a: DataFrame, b: DataFrame, more_than: int = 25, by: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Pixels whose greatest channel difference (r, g, b) is more than a bound."""
    k = [*by, "u", "v"]
    other = b.select(*k, *(F.col(c).alias(f"_{c}") for c in "rgb"))
    off = F.greatest(*(F.abs(F.col(c) - F.col(f"_{c}")) for c in "rgb"))
    return a.join(other, k).groupBy(*by).agg(F.count("*").alias("pixels"), F.count_if(off > more_than).alias("changed"))


def sample_points(points: DataFrame, k: int, seed: str, by: Sequence[str] = ("scene_id", "role")) -> DataFrame:
    """k points of each role in a hash order; roles with fewer repeat theirs in that order until k."""
    order = F.sha2(F.concat_ws("\u0000", F.lit(seed), *(F.col(c).cast("string") for c in (*by, "point_id"))), 256)
    n = F.count("*").over(Window.partitionBy(*by))
    ranked = points.withColumns({"_r": F.row_number().over(Window.partitionBy(*by).orderBy(order)), "_n": n}).filter(F.col("_r") <= k)
    again = F.sequence(F.col("_r").cast("bigint"), F.lit(k).cast("bigint"), F.least(F.col("_n"), F.lit(k)))
    return ranked.withColumn("slot", F.explode(again)).drop("_r", "_n")


def coverage_audit(objects: DataFrame, *claims: tuple[str, DataFrame]) -> DataFrame:
    """Scenes and objects that a claim (a table of scene_id, object_id) lacks or has beyond the objects."""
    out = None
    for name, claim in claims:
        k = ["scene_id", "object_id"]
        both = objects.select(*k, F.lit(1).alias("o")).join(claim.select(*k, F.lit(1).alias("c")).distinct(), k, "full_outer").filter("o IS NULL OR c IS NULL")
        part = both.select(*k, F.lit(name).alias("claim"), F.when(F.col("c").isNull(), "missing").otherwise("extra").alias("side"))
        out = part if out is None else out.unionByName(part)
    return out


def clearance_limits(moves: DataFrame, obstacles: DataFrame, bounds: Column, key: Sequence[str], scene: str = "scene_id", gap: float = 0.002, most: float = 0.45) -> DataFrame:
    """How far each move (struct r, vx, vy) can go: a join on the scene and a least over its obstacles (struct o)."""
    met = moves.join(obstacles.select(scene, "o"), scene, "left")
    first = F.min(G.contact(F.col("r"), F.col("vx"), F.col("vy"), F.col("o"), gap))
    limit = G.bounds_limit(F.col("r"), F.col("vx"), F.col("vy"), bounds, gap, most)
    out = met.groupBy(*dict.fromkeys([scene, *key])).agg(F.first(limit).alias("_b"), first.alias("_c"))
    return out.select(scene, *(k for k in key if k != scene), F.greatest(F.least("_b", "_c"), F.lit(0.0)).alias("limit"))


def escape_distance(r: Column, vx: Column, vy: Column, strip: Column, step: float, limit: Column) -> Column:
    """The least multiple of step, below limit, at which a sliding rectangle has left a strip; null if there is none.

    The area in common is 0 once either side has moved past, so the distance is the
    lesser of two quotients and no search is needed.
    """
    past = [
        F.when(vx > 0, (strip["xmax"] - r["xmin"]) / vx).when(vx < 0, (strip["xmin"] - r["xmax"]) / vx),
        F.when(vy > 0, (strip["ymax"] - r["ymin"]) / vy).when(vy < 0, (strip["ymin"] - r["ymax"]) / vy),
    ]
    n = F.greatest(F.ceil(F.least(*past) / step - 1e-9), F.lit(1))
    return F.when(n <= F.floor((limit - 1e-8) / step), n * step)


def translation_candidates(scenes: DataFrame, obstacles: DataFrame, bounds: Column, margin: float, step: float = 0.001, gap: float = 0.002, most: float = 0.45) -> DataFrame:
    """For each scene and compass direction the least slide of the blocker that clears the target's corridor.

    scenes: scene_id, target and blocker (structs); obstacles: scene_id, o, without the
    blocker; the target is one. Scenes whose blocker isn't in the corridor, or in
    which another obstacle is, have none. Ranked by distance, then direction.
    """
    strip = G.corridor(F.col("target"), bounds["ymin"], margin)
    table = F.array(*(F.struct(F.lit(n).alias("direction"), F.cos(F.radians(F.lit(a))).alias("vx"), F.sin(F.radians(F.lit(a))).alias("vy")) for n, a in G.D8.items()))
    clean = lambda c: F.when(F.abs(c) < 1e-12, 0.0).otherwise(c)
    open_ = scenes.withColumn("strip", strip).filter(G.overlap(F.col("blocker"), F.col("strip")) > 1e-8)
    shut = open_.join(obstacles, "scene_id").filter(G.overlap(F.col("o"), F.col("strip")) > 1e-8).select("scene_id").distinct()
    moves = open_.join(shut, "scene_id", "left_anti").select("scene_id", F.col("blocker").alias("r"), "strip", F.explode(table).alias("d"))
    moves = moves.select("scene_id", "r", "strip", "d.direction", clean(F.col("d.vx")).alias("vx"), clean(F.col("d.vy")).alias("vy"))
    things = obstacles.select("scene_id", "o").unionByName(scenes.select("scene_id", F.col("target").alias("o")))
    limits = clearance_limits(moves, things, bounds, ["direction"], gap=gap, most=most)
    out = moves.join(limits, ["scene_id", "direction"]).withColumn("distance", escape_distance(F.col("r"), F.col("vx"), F.col("vy"), F.col("strip"), step, F.col("limit")))
    rank = F.row_number().over(Window.partitionBy("scene_id").orderBy("distance", "direction"))
    return out.filter("distance IS NOT NULL").select("scene_id", "direction", "distance", "limit").withColumn("rank", rank)


def box_of(polygon: str) -> Column:
    xs, ys = F.col(polygon)["x"], F.col(polygon)["y"]
    return G.rect(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def boxed(df: DataFrame, polygon: str) -> DataFrame:
    """df with each polygon's box, as what is exploded: filters and joins on it don't compute it again."""
    return df.select("*", F.explode(F.array(box_of(polygon))).alias("box"))


#: Scenes with at most so many boxes on either side are compared as they are; larger ones are dealt by cells.
SMALL_SCENE = 64


def meeting_boxes(left: DataFrame, right: DataFrame, scene: str = "scene_id", box: str = "box", within: float = 0.0, suffixes: tuple[str, str] = ("_a", "_b"), small: int = SMALL_SCENE) -> DataFrame:
    """Pairs of a left and a right row of one scene whose boxes are at most ``within`` apart in x and in y: all columns, with suffixes but for the scene's.

    Scenes of at most ``small`` rows on both sides are joined by scene. In larger ones
    there is a grid for each power of two. A box lies in the cells of the grid whose
    cells are as large as itself, four at most; a row looks for others in its own grid
    and in those of all larger sizes that occur. A pair meets in the cell of the lower corner
    of what their boxes share, and nowhere else. So a scene with any number of objects
    is dealt to many tasks by its cells. Rows without a whole box meet nothing.
    """

    def whole(df: DataFrame) -> DataFrame:
        r = F.col(box)
        known = df.filter(F.col(scene).isNotNull() & r["xmin"].isNotNull() & r["ymin"].isNotNull() & r["xmax"].isNotNull() & r["ymax"].isNotNull())
        return known.select(F.col(scene).alias("_scene"), F.struct("*").alias("_row"))

    def sized(df: DataFrame) -> DataFrame:
        r = F.col("_row")[box]
        size = F.greatest(r["xmax"] - r["xmin"], r["ymax"] - r["ymin"], F.lit(float(within)), F.lit(2.0**-40))
        return checkpointed(df.withColumn("_level", F.ceil(F.log2(size)).cast("int")))

    one, two = suffixes
    a = whole(left)
    b = a if right is left else whole(right)
    columns = [F.col(f"_row{x}.`{c}`").alias(f"{c}{x}") for x, df in ((one, left), (two, right)) for c in df.columns if c != scene]
    counts = a.groupBy("_scene").count() if b is a else a.groupBy("_scene").count().unionByName(b.groupBy("_scene").count())
    large = checkpointed(counts.filter(F.col("count") > small).select("_scene").distinct())

    def named(df: DataFrame, x: str, *more: Column) -> DataFrame:
        return df.select(F.col("_scene").alias(f"_scene{x}"), F.col("_row").alias(f"_row{x}"), *more)

    def shared_corner(n: str) -> Column:
        return F.greatest(F.col(f"_row{one}")[box][f"{n}min"] - within, F.col(f"_row{two}")[box][f"{n}min"])

    met = reduce(Column.__and__, (shared_corner(n) <= F.least(F.col(f"_row{one}")[box][f"{n}max"] + within, F.col(f"_row{two}")[box][f"{n}max"]) for n in "xy"))
    same = F.col(f"_scene{one}") == F.col(f"_scene{two}")
    anything_large = not large.isEmpty()
    few = [df.join(large, "_scene", "left_anti") if anything_large else df for df in (a, b)]
    pairs = named(few[0], one).join(named(few[1], two), same & met)
    if anything_large:
        same_rows, a = b is a, sized(a.join(large, "_scene", "left_semi"))
        b = a if same_rows else sized(b.join(large, "_scene", "left_semi"))
        levels = sorted({r[0] for df in (a, b) for r in df.select("_level").distinct().collect()})  # powers of two that occur: few, whatever the rows

        def dealt(df: DataFrame, x: str, level: Column, by: float) -> DataFrame:
            """A row for each cell that the box, widened by ``by``, touches on its level's grid."""
            cell = F.pow(F.lit(2.0), level)
            span = lambda n: F.sequence(F.floor((F.col("_row")[box][f"{n}min"] - by) / cell), F.floor((F.col("_row")[box][f"{n}max"] + by) / cell))
            across = named(df, x, level.alias(f"_l{x}"), F.explode(span("x")).alias(f"_x{x}"), span("y").alias("_ys"))
            return across.withColumn(f"_y{x}", F.explode("_ys")).drop("_ys")

        def searched(asking: str | None) -> DataFrame:
            """Left rows in the grids of larger right ones, right rows in those of larger left ones, or rows of one size."""
            above = F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda n: n > F.col("_level")))
            own = F.col("_level")
            l_side = dealt(a.withColumn("_at", above), one, F.col("_at"), within) if asking == "left" else dealt(a, one, own, within)
            r_side = dealt(b.withColumn("_at", above), two, F.col("_at"), 0.0) if asking == "right" else dealt(b, two, own, 0.0)
            keys = reduce(Column.__and__, (F.col(f"_{k}{one}") == F.col(f"_{k}{two}") for k in ("scene", "l", "x", "y")))
            cell = F.pow(F.lit(2.0), F.col(f"_l{one}"))
            here = reduce(Column.__and__, (F.floor(shared_corner(n) / cell) == F.col(f"_{n}{one}") for n in "xy"))
            return l_side.join(r_side, keys & met & here).select(*pairs.columns)

        for asking in (None, "left", "right") if len(levels) > 1 else (None,):
            pairs = pairs.unionByName(searched(asking))
    return pairs.select(F.col(f"_scene{one}").alias(scene), *columns)


def near_objects(objects: DataFrame, within: float, scene: str = "scene_id", key: str = "object_id", polygon: str = "polygon") -> DataFrame:
    """Pairs of a scene's objects at most ``within`` apart, found by meeting_boxes: a scene may have any number of objects.

    The distance of the polygons stands in what is exploded, where it is computed once,
    and not in a filter, which would be moved ahead of the boxes.
    """
    things = boxed(objects.select(scene, key, polygon), polygon)
    pairs = meeting_boxes(things, things, scene, within=within).filter(F.col(f"{key}_a") < F.col(f"{key}_b"))
    measured = pairs.select(scene, f"{key}_a", f"{key}_b", P.distance(F.col(f"{polygon}_a"), F.col(f"{polygon}_b")).alias("_d"))
    return measured.select(scene, f"{key}_a", f"{key}_b", F.explode(F.filter(F.array("_d"), lambda d: d <= within)).alias("distance"))


def path_check(moves: DataFrame, obstacles: DataFrame, bounds: tuple[float, float, float, float], step: float = 0.25, key: Sequence[str] = ("scene_id", "move_id"), turn_step: float = 5.0, action: Column | None = None, mover: Column | None = None) -> DataFrame:
    """Each move's path in substeps: the first step that leaves the bounds or meets an obstacle, and which.

    moves: scene_id, the key, polygon, degrees, distance; obstacles: scene_id,
    object_id, polygon. ``action`` is TRANSLATE (without it, all moves slide: distance
    along degrees), ROTATE (distance is the angle, degrees its sign; a path repeats
    after 360) or anything else, which has no path. ``mover`` is the moving object's
    id, if obstacles has it too. Returns steps, executed, first_step, outside, hits
    (ids met at that step), clear, fraction (of the distance, where it ends) and footprint.

    Only obstacles whose box meets that of the whole path are looked at (meeting_boxes).
    A slide's first step follows from the interval of contact; a turn is tried step by
    step up to the first that fails.
    """
    action = F.lit("TRANSLATE") if action is None else action
    whole = F.when(action == "ROTATE", F.least("distance", F.lit(360.0))).otherwise(F.col("distance")).cast("double")
    each = F.when(action == "ROTATE", F.lit(float(turn_step))).when(action == "TRANSLATE", F.lit(float(step)))
    m = moves.withColumns({"_action": action, "_whole": whole, "_each": each, "_mover": F.lit(None) if mover is None else mover})
    m = m.withColumn("_n", F.greatest(F.ceil(F.col("_whole") / F.col("_each")), F.lit(1)).cast("int"))
    p, along = F.col("polygon"), G.direction_vector(F.col("degrees"))

    def at(i: Column) -> Column:
        """The polygon after i steps."""
        d = F.least(i * F.col("_each"), F.col("_whole"))
        return F.when(F.col("_action") == "ROTATE", G.rotated(p, F.col("degrees") * d)).otherwise(G.let(F.struct((along["x"] * d).alias("x"), (along["y"] * d).alias("y")), lambda v: G.translated(p, v["x"], v["y"])))

    other = obstacles.select("scene_id", F.col("object_id").alias("_hit"), F.col("polygon").alias("_op"))
    other = boxed(other, "_op")
    move = [F.col(c) for c in ("polygon", "degrees", "_action", "_each", "_whole", "_n")]
    m = m.withColumn("_own", P.path(*move, bounds))
    asked = m.select(*dict.fromkeys(["scene_id", *key, "polygon", "degrees", "_action", "_whole", "_each", "_n", "_mover"]), G.rect(*(F.col(f"_own.{c}") for c in ("xmin", "ymin", "xmax", "ymax"))).alias("box"))
    met = meeting_boxes(asked, other, within=2 * G.TOLERANCE, suffixes=("", "_o")).withColumnsRenamed({"_hit_o": "_hit", "_op_o": "_op"}).filter(~F.col("_hit").eqNullSafe(F.col("_mover")))
    met = met.select(*key, "_hit", P.meeting_step(*move, F.col("_op")).cast("bigint").alias("_at"))
    met = met.select(*key, "_hit", F.explode(F.filter(F.array("_at"), lambda i: i.isNotNull())).alias("_at"))
    hits = met.groupBy(*key).agg(F.min("_at").alias("_met"), F.collect_list(F.struct("_at", "_hit")).alias("_hits"))
    out = m.join(hits, list(key), "left").withColumn("_out", F.col("_own.out").cast("bigint"))
    out = out.withColumn("first_step", F.least("_met", "_out")).withColumn("steps", F.coalesce("_n", F.lit(1)))
    out = out.withColumn("executed", F.coalesce("first_step", "steps"))
    now = F.transform(F.filter("_hits", lambda h: h["_at"] == F.col("first_step")), lambda h: h["_hit"])
    share = F.coalesce(F.try_divide(F.least(F.col("executed") * F.col("_each"), F.col("_whole")), F.col("distance")), F.lit(1.0))
    results = {
        "outside": F.coalesce(F.col("_out") == F.col("first_step"), F.lit(False)),
        "hits": F.coalesce(F.array_sort(now), F.array().cast(f"array<{obstacles.schema['object_id'].dataType.simpleString()}>")),
        "clear": F.col("first_step").isNull(),
        "fraction": share,
        "footprint": F.when(F.col("_each").isNull(), F.col("polygon")).otherwise(at(F.col("executed"))),
    }
    return out.select(*key, "steps", "executed", "first_step", *(c.alias(n) for n, c in results.items()))


def short_of(distance: Column, limit: Column) -> Column:
    """Whether a slide ends before its limit. One that ends there but for a rounding (1e-8, as in escape_distance) doesn't."""
    return distance < limit - 1e-8


def static_validity(moves: DataFrame, obstacles: DataFrame, bounds: Column, margin: float, gap: float = 0.002, most: float = 0.45) -> DataFrame:
    """Whether a stated slide of each scene's blocker clears the target's corridor without meeting anything.

    moves: scene_id, target and blocker (structs), vx, vy, distance; obstacles:
    scene_id, o, without both. Returns corridor_overlap, corridor_clear,
    clearance_limit, collision_free (short of the limit and within the bounds) and valid.
    """
    goal = G.moved(F.col("blocker"), F.col("vx") * F.col("distance"), F.col("vy") * F.col("distance"))
    things = obstacles.select("scene_id", "o").unionByName(moves.select("scene_id", F.col("target").alias("o")))
    limits = clearance_limits(moves.withColumnRenamed("blocker", "r"), things, bounds, ["scene_id"], gap=gap, most=most).withColumnRenamed("limit", "clearance_limit")
    out = moves.join(limits, "scene_id").withColumn("corridor_overlap", G.overlap(goal, G.corridor(F.col("target"), bounds["ymin"], margin)))
    clear, free = F.col("corridor_overlap") <= 1e-10, short_of(F.col("distance"), F.col("clearance_limit")) & G.rect_inside(goal, bounds, gap)
    return out.select("scene_id", "corridor_overlap", clear.alias("corridor_clear"), "clearance_limit", free.alias("collision_free"), (clear & free).alias("valid"))


def finger_zones(objects: DataFrame, zones: DataFrame, scene: str = "scene_id", key: str = "object_id", polygon: str = "polygon", tolerance: float = 1e-7) -> DataFrame:
    """Each object's finger zones (left and right, from ``zones``: scene, key, side, zone) and the other objects in them; free if there are none.

    meeting_boxes finds the objects whose boxes meet a zone's; only their polygons are compared.
    """
    things = boxed(objects.select(scene, F.col(key).alias("_other"), F.col(polygon).alias("_p")), "_p")
    asked = boxed(zones.select(scene, key, "side", "zone"), "zone")
    met = meeting_boxes(asked, things, scene, within=tolerance, suffixes=("", "_o")).filter(F.col(key) != F.col("_other_o"))
    measured = met.select(scene, key, "side", "_other_o", P.distance(F.col("zone"), F.col("_p_o")).alias("_d"))
    hits = measured.select(scene, key, "side", F.explode(F.filter(F.array(F.when(F.col("_d") <= tolerance, F.col("_other_o"))), lambda o: o.isNotNull())).alias("_hit"))
    found = hits.groupBy(scene, key, "side").agg(F.array_sort(F.collect_set("_hit")).alias("_by"))
    none = F.array().cast(f"array<{objects.schema[key].dataType.simpleString()}>")
    out = zones.select(scene, key, "side").distinct().join(found, [scene, key, "side"], "left").withColumn("occupied_by", F.coalesce("_by", none)).drop("_by")
    return out.withColumn("free", F.size("occupied_by") == 0)


def _sides(r: Column, width: float) -> dict[str, Column]:
    """The strips of a width at the left and right side of a box, as polygons."""

    def zone(low: Column, high: Column) -> Column:
        return F.array(G.point(low, r["ymin"]), G.point(high, r["ymin"]), G.point(high, r["ymax"]), G.point(low, r["ymax"]))

    return {"LEFT": zone(r["xmin"] - width, r["xmin"]), "RIGHT": zone(r["xmax"], r["xmax"] + width)}


def gripper_zones(targets: DataFrame, width: float, scene: str = "scene_id", key: str = "object_id", polygon: str = "polygon") -> DataFrame:
    """Where a gripper's two fingers would go: the strips of a width at the left and right side of each target's box, as deep as the box.

    Returns scene, key, side (LEFT, RIGHT) and zone, for finger_zones.
    """
    sides = _sides(box_of(polygon), width)
    return targets.select(scene, key, F.inline(F.array(*(F.struct(F.lit(n).alias("side"), z.alias("zone")) for n, z in sides.items()))))


def relation_payloads(objects: DataFrame, targets: DataFrame, near: float = 5.0, scene: str = "scene_id", key: str = "object_id", polygon: str = "polygon", centre: str = "centre", finger_width: float | None = None) -> DataFrame:
    """What each scene's target has around it, in numbers and in words: scene, target_id, R_NUMERIC, R_QUALITATIVE_D4, R_QUALITATIVE_D8.

    objects: scene, key, polygon and centre (a point) in centimetres; targets: scene,
    target_id. Each payload is an array of structs in the order of the ids: gap,
    bearing and arcs, or direction, sides and whether the gap is at most ``near``.
    With ``finger_width`` the numbers have the distances to both finger zones of that width too, and
    the words say which zones an object is in, in place of whether it is near.
    """
    ids = targets.select(F.col(scene).alias("_s"), "target_id")
    target = ids.join(objects, (F.col("_s") == F.col(scene)) & (F.col("target_id") == F.col(key))).select("_s", "target_id", F.col(polygon).alias("_tp"), F.col(centre).alias("_tc"))
    met = objects.join(target, (F.col(scene) == F.col("_s")) & (F.col(key) != F.col("target_id")))
    away = {n: F.col(centre)[n] - F.col("_tc")[n] for n in "xy"}
    zones = {} if finger_width is None else _sides(box_of("_tp"), finger_width)
    around = P.around(F.col("_tp"), F.col("_tc")["x"], F.col("_tc")["y"], F.col(polygon), zones)
    met = met.select(scene, "target_id", key, G.bearing(away["x"], away["y"]).alias("bearing"), around.alias("_a"))
    arcs = F.when(F.col("_a.first").isNull(), F.array().cast(G.ARCS)).otherwise(G.split_arc(F.col("_a.first"), F.col("_a.last")))
    # to nine places, so that a rounding error decides no tie of the coarser rounding
    near_zones = F.struct(*(F.round(F.col("_a")[n], 9).alias(n) for n in zones)).alias("zones") if zones else F.lit(None).alias("zones")
    # what is exploded is computed once; projections would be merged, and arcs computed for each direction
    seen = met.select(scene, "target_id", key, F.inline(F.array(F.struct("bearing", F.col("_a.gap").alias("gap"), near_zones, arcs.alias("arcs")))))

    def numeric() -> Column:
        more = [F.struct(*(F.round(F.col("zones")[n], 3).alias(n) for n in zones)).alias("distance_to_finger_placement_zone_cm")] if zones else []
        return F.struct(F.col(key), F.round(F.col("gap"), 1).alias("surface_gap_cm"), F.round(F.col("bearing"), 1).alias("center_bearing_deg"), F.col("arcs").alias("occupied_angular_sectors_deg"), *more)

    def words(names: dict[str, float]) -> Column:
        if zones:
            room = F.array_compact(F.array(*(F.when(F.col("zones")[n] <= G.TOLERANCE, F.lit(n)) for n in zones))).alias("finger_placement_zones_occupied")
        else:
            room = F.when(F.col("gap") <= near, "CLEARANCE_ZONE_OVERLAP").otherwise("CLEARANCE_ZONE_CLEAR").alias("clearance_zone")
        return F.struct(F.col(key), G.nearest_direction(F.col("bearing"), names).alias("center_direction"), G.occupied_directions([F.get(F.col("arcs"), F.lit(i)) for i in (0, 1)], names).alias("occupied_target_sides"), room)

    kinds = {"R_NUMERIC": numeric, "R_QUALITATIVE_D4": lambda: words(G.D4), "R_QUALITATIVE_D8": lambda: words(G.D8)}
    each = seen.select(scene, "target_id", *(use().alias(n) for n, use in kinds.items()))
    return each.groupBy(scene, "target_id").agg(*(F.sort_array(F.collect_list(n)).alias(n) for n in kinds))


def relation_documents(objects: DataFrame, targets: DataFrame, near: float = 5.0, scene: str = "scene_id", key: str = "object_id", polygon: str = "polygon", centre: str = "centre", finger_width: float | None = None) -> DataFrame:
    """relation_payloads as JSON documents, three for each target: scene, target_id, payload (its name) and document.

    A target that stands alone has documents without relations; one that isn't among the objects has none.
    With ``finger_width`` they tell the gripper and which of its zones is occupied, too.
    """
    targets = targets.select(scene, "target_id").distinct()
    found = relation_payloads(objects, targets, near, scene, key, polygon, centre, finger_width)
    there = targets.join(objects.select(scene, F.col(key).alias("target_id")), [scene, "target_id"], "left_semi")
    kinds = ("R_NUMERIC", "R_QUALITATIVE_D4", "R_QUALITATIVE_D8")
    whole = there.join(found, [scene, "target_id"], "left").withColumns({k: F.coalesce(k, F.array().cast(found.schema[k].dataType)) for k in kinds})

    def document(kind: str) -> Column:
        condition, _, resolution = kind.partition("_D")
        head = [F.lit(condition).alias("condition"), *([F.lit(f"D{resolution}").alias("direction_resolution")] if resolution else []), "target_id", F.col(kind).alias("relations")]
        if finger_width is not None and not resolution:
            head.append(F.struct(F.lit("PARALLEL_JAW").alias("type"), F.lit("SHELF_LEFT_RIGHT").alias("closing_axis"), F.lit(float(finger_width)).alias("required_side_clearance_cm")).alias("gripper"))
        elif finger_width is not None:
            taken = lambda side: F.when(F.exists(kind, lambda r: F.array_contains(r["finger_placement_zones_occupied"], side)), "OCCUPIED").otherwise("CLEAR").alias(side)
            head.append(F.struct(taken("LEFT"), taken("RIGHT")).alias("finger_placement_zone_status"))
        return F.struct(F.lit(kind).alias("payload"), F.to_json(F.struct(*head)).alias("document"))

    return whole.select(scene, "target_id", F.inline(F.array(*map(document, kinds))))


def motion_documents(objects: DataFrame, bounds: tuple[float, float, float, float], step: float = 0.25, most: float = 100.0, scene: str = "scene_id", key: str = "object_id", polygon: str = "polygon") -> DataFrame:
    """motion_payloads of all objects as JSON documents, eight for each scene (free space and motion, in numbers and words, by four and eight directions): scene, payload (its name) and document.

    A document lists a scene's objects in the order of their ids, so it is as long as the scene.
    """
    fields = {
        "F_NUMERIC": {"free_space_cm": "F_NUMERIC"},
        "F_QUALITATIVE": {"free_space_level": "F_QUALITATIVE"},
        "M_NUMERIC": {"max_safe_translation_cm": "M_NUMERIC", "max_safe_rotation_deg": "turn_deg"},
        "M_QUALITATIVE": {"max_safe_translation_level": "M_QUALITATIVE", "max_safe_rotation_level": "turn_level"},
    }
    parts = []
    for resolution, names in (("D4", G.D4), ("D8", G.D8)):
        moves = motion_payloads(objects, bounds, names, step, most, scene=scene, key=key, polygon=polygon)
        told = F.array(*(F.struct(F.lit(kind).alias("condition"), F.to_json(F.struct(key, *(F.col(c).alias(n) for n, c in into.items()))).alias("object")) for kind, into in fields.items()))
        parts.append(moves.select(scene, key, F.inline(told)).withColumn("resolution", F.lit(resolution)))
    lists = parts[0].unionByName(parts[1]).groupBy(scene, "condition", "resolution").agg(F.sort_array(F.collect_list(F.struct(key, "object"))).alias("o"))
    listed = F.array_join(F.transform("o", lambda r: r["object"]), ",")
    document = F.format_string('{"condition":"%s","direction_resolution":"%s","objects":[%s]}', "condition", "resolution", listed)
    return lists.select(scene, F.concat_ws("_", "condition", "resolution").alias("payload"), document.alias("document"))


def motion_payloads(objects: DataFrame, bounds: tuple[float, float, float, float], directions: dict[str, float], step: float = 0.25, most: float = 100.0, only: Column | None = None, scene: str = "scene_id", key: str = "object_id", polygon: str = "polygon") -> DataFrame:
    """Room and motion of each object among the others of its scene: scene, key, F_NUMERIC, F_QUALITATIVE, M_NUMERIC, M_QUALITATIVE.

    The four payloads are maps by direction (free space in centimetres or as a level;
    whole centimetres or the level of the longest slide); turn_deg and turn_level are
    maps by CW and CCW. ``only`` picks the objects that get a row.
    """
    other = objects.select(F.col(scene).alias("_s"), F.col(key).alias("_k"), F.col(polygon).alias("_p"))
    mine = objects if only is None else objects.filter(only)
    met = mine.join(other, (F.col(scene) == F.col("_s")) & (F.col(key) != F.col("_k")), "left")
    found = least_room(met, (scene, key), polygon, "_p", list(directions.values()), bounds, step, most)
    by = lambda names, values: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*values))
    free, slide = ([F.col(f"{c}_{i}") for i in range(len(directions))] for c in ("free", "slide"))
    turn = [F.col(c).cast("int") for c in ("turn_cw", "turn_ccw")]
    return found.select(
        scene, key,
        by(directions, [F.round(v, 1) for v in free]).alias("F_NUMERIC"), by(directions, map(B.free_space_level, free)).alias("F_QUALITATIVE"),
        by(directions, [F.floor(v + 1e-9) for v in slide]).alias("M_NUMERIC"), by(directions, map(B.translation_level, slide)).alias("M_QUALITATIVE"),
        by(("CW", "CCW"), turn).alias("turn_deg"), by(("CW", "CCW"), map(B.rotation_level, turn)).alias("turn_level"),
    )


def least_room(pairs: DataFrame, by: Sequence[str], polygon: str, other: str, degrees: list[float], bounds: tuple[float, float, float, float], step: float, most: float, turns: bool = True) -> DataFrame:
    """planar.room of each polygon among all it is paired with: the least over its pairs, so no scene is gathered in a row."""
    each = pairs.select(*by, P.room(F.col(polygon), F.col(other), degrees, bounds, step, most, turns=turns).alias("_r"))
    return each.groupBy(*by).agg(*(F.min(f"_r.{c}").alias(c) for c in each.schema["_r"].dataType.names))


#: Distances that a catalogue may have: it travels with each row.
CATALOGUE = 100_000


def action_catalogue(training: DataFrame, least_mm: int = 20, most_mm: int = 250, step_mm: int = 5, scene: str = "scene_id", distance: str = "distance") -> DataFrame:
    """The distances (m) that a move is chosen from: an even grid, and every training distance off it, so that a move that was taught is there even where safe ones are closer than the grid.

    Distances are whole micrometres. Returns distance and first_scene, the least scene that brings it; null for the grid's.
    Rows of other splits aren't to be handed in. Training rows without a distance bring none.
    """
    grid = training.sparkSession.range(least_mm, most_mm + 1, step_mm).select((F.col("id") * 1000).alias("um"), F.lit(True).alias("grid"), F.lit(None).cast(training.schema[scene].dataType).alias("by"))
    taught = training.filter(F.col(distance).isNotNull()).select(F.round(F.col(distance) * 1e6).cast("long").alias("um"), F.lit(False).alias("grid"), F.col(scene).alias("by"))
    return grid.unionByName(taught).groupBy("um").agg(F.when(~F.bool_or("grid"), F.min("by")).alias("first_scene")).select((F.col("um") / 1e6).alias("distance"), "first_scene")


def catalogue_masks(moves: DataFrame, obstacles: DataFrame, catalogue: DataFrame, bounds: Column, margin: float, gap: float = 0.002, most: float = 0.45) -> DataFrame:
    """Which distances of a catalogue are valid slides of each scene's blocker in each direction.

    moves: scene_id, direction, target and blocker (structs), vx, vy; obstacles: scene_id, o, without
    both. Returns scene_id, direction, limit and allowed, the valid distances in order. Valid as in
    static_validity: the target's corridor is cleared, nothing is met and the bounds are kept.
    The catalogue is one row of at most CATALOGUE numbers beside each move; more are an error.
    """
    n = F.count("*")
    grid = catalogue.agg(F.when(n > CATALOGUE, F.raise_error(F.lit(f"more than {CATALOGUE} distances")).cast("array<double>")).otherwise(F.array_sort(F.collect_list("distance"))).alias("_grid"))
    things = obstacles.select("scene_id", "o").unionByName(moves.select("scene_id", F.col("target").alias("o")).distinct())
    limits = clearance_limits(moves.withColumnRenamed("blocker", "r"), things, bounds, ["direction"], gap=gap, most=most)
    strip = G.corridor(F.col("target"), bounds["ymin"], margin)

    def valid(d: Column) -> Column:
        goal = G.moved(F.col("blocker"), F.col("vx") * d, F.col("vy") * d)
        return short_of(d, F.col("limit")) & (G.overlap(goal, F.col("_strip")) <= 1e-10) & G.rect_inside(goal, bounds, gap)

    out = moves.withColumn("_strip", strip).join(limits, ["scene_id", "direction"]).join(F.broadcast(grid))
    return out.select("scene_id", "direction", "limit", F.filter("_grid", valid).alias("allowed"))


def untaught(masks: DataFrame, training: DataFrame) -> DataFrame:
    """Training rows (scene_id, direction, distance) that their own masks contradict: covered (some distance of their direction is allowed) and valid (their own distance is), where either is false."""
    both = training.select("scene_id", "direction", "distance").join(masks.select("scene_id", "direction", "allowed"), ["scene_id", "direction"], "left")
    own = F.exists("allowed", lambda d: F.abs(d - F.round(F.col("distance"), 6)) < 1e-9)
    told = both.select("scene_id", "direction", "distance", F.coalesce(F.size("allowed") > 0, F.lit(False)).alias("covered"), F.coalesce(own, F.lit(False)).alias("valid"))
    return told.filter(~F.col("covered") | ~F.col("valid"))
