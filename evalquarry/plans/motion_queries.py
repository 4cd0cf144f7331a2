"""Queries of moves, of the room around objects and of the payloads that tell both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import scene
from .catalog import define, r6
from .shape_queries import near_zero, near_zero_sql
from .value_queries import BOX, boxes, by_order, polygons, shelf

SHELF = (-30.0, 30.0, -30.0, 30.0)

#: Squares in centimetres: centre and half a side.
SINGLE = f"SELECT scene_id, object_id, 100 * min(x) AS x, 100 * min(y) AS y, 50 * min(w) AS h FROM ({BOX}) GROUP BY ALL"

#: How far the ray from the centre (m) goes to the near side of a square (o), or to its far side from within; u is along the ray.
AHEAD = {0: ("o.x - m.x", "o.y - m.y"), 90: ("o.y - m.y", "o.x - m.x"), 180: ("m.x - o.x", "o.y - m.y"), 270: ("m.y - o.y", "o.x - m.x")}
RAY = " UNION ALL ".join(
    f"SELECT m.scene_id, m.object_id, {a} AS degrees, m.h, 30 - ({ {0: 'm.x', 90: 'm.y', 180: '-m.x', 270: '-m.y'}[a] }) AS wall, {u} AS u, {v} AS v, o.h AS oh FROM m LEFT JOIN b o ON o.scene_id = m.scene_id AND o.object_id <> m.object_id" for a, (u, v) in AHEAD.items()
)
#: free and capacity by scene, object and direction, from m (the objects that are asked about) and b (all).
ROOM = (
    f"r AS ({RAY}), k AS (SELECT scene_id, object_id, degrees, h, wall, min(CASE WHEN abs(v) > oh + 1e-8 THEN NULL WHEN u - oh >= -1e-9 THEN u - oh WHEN u + oh >= -1e-9 THEN u + oh END) AS hit FROM r GROUP BY ALL), "
    "t AS (SELECT r.scene_id, r.object_id, r.degrees, min(i) AS first FROM r, range(1, {last}) s(i) WHERE i * {step} > wall - h + 1e-7 OR (abs(v) <= h + oh + 1e-7 AND abs(u - i * {step}) <= h + oh + 1e-7) GROUP BY ALL), "
    "room AS (SELECT k.scene_id, k.object_id, k.degrees, greatest(0, least(wall, coalesce(hit, wall)) - h) AS free, (coalesce(first, {last}) - 1) * {step} AS capacity FROM k LEFT JOIN t USING (scene_id, object_id, degrees))"
)

#: Squares a and o apart: on the axes, or on those of a, which is turned by w.
APART = "abs(o.x - a.x) > a.e + o.h + 1e-7 OR abs(o.y - a.y) > a.e + o.h + 1e-7 OR abs((o.x - a.x) * cos(a.w) + (o.y - a.y) * sin(a.w)) > a.h + o.h * (abs(cos(a.w)) + abs(sin(a.w))) + 1e-7 OR abs((o.y - a.y) * cos(a.w) - (o.x - a.x) * sin(a.w)) > a.h + o.h * (abs(cos(a.w)) + abs(sin(a.w))) + 1e-7"
OUTSIDE = "abs(a.x) + a.e > 30.0000001 OR abs(a.y) + a.e > 30.0000001"

PATHS = (
    f"WITH b AS ({SINGLE}), m AS (SELECT scene_id, x, y, h, ['TRANSLATE', 'ROTATE', 'RETRIEVE'][scene_id % 3 + 1] AS action, radians(scene_id % 4 * 90) AS t, CASE WHEN scene_id % 2 = 0 THEN 1 ELSE -1 END AS turn, CASE WHEN scene_id % 3 = 0 THEN CAST(scene_id % 7 AS DOUBLE) * 1.3 ELSE CAST(scene_id % 11 AS DOUBLE) * 37.5 END AS asked FROM b WHERE object_id = 1), "
    "n AS (SELECT *, CASE action WHEN 'ROTATE' THEN least(asked, 360) ELSE asked END AS whole, CASE action WHEN 'ROTATE' THEN 5.0 ELSE 0.25 END AS each FROM m), s AS (SELECT *, CASE action WHEN 'RETRIEVE' THEN 1 ELSE greatest(CAST(ceil(whole / each) AS BIGINT), 1) END AS steps FROM n), "
    "p AS (SELECT *, least(i * each, whole) AS d FROM (SELECT *, unnest(range(1, steps + 1)) AS i FROM s WHERE action <> 'RETRIEVE')), q AS (SELECT scene_id, i, h, d, CASE action WHEN 'TRANSLATE' THEN x + d * cos(t) ELSE x END AS x, CASE action WHEN 'TRANSLATE' THEN y + d * sin(t) ELSE y END AS y, CASE action WHEN 'ROTATE' THEN radians(turn * d) ELSE 0 END AS w FROM p), "
    f"a AS (SELECT *, h * (abs(cos(w)) + abs(sin(w))) AS e FROM q), c AS (SELECT a.scene_id, a.i, {OUTSIDE} AS outside, coalesce(list(o.object_id ORDER BY o.object_id) FILTER (NOT ({APART})), []) AS hits FROM a LEFT JOIN b o ON o.scene_id = a.scene_id AND o.object_id > 1 GROUP BY ALL), f AS (SELECT scene_id, min(i) AS first_step FROM c WHERE outside OR len(hits) > 0 GROUP BY scene_id) "
)


@define(
    PATHS + "SELECT s.scene_id, s.action, s.steps, coalesce(first_step, steps) AS executed, first_step, coalesce(c.outside, false) AS outside, coalesce(c.hits, []) AS hits, round(CASE WHEN s.asked > 0 AND a.d IS NOT NULL THEN a.d / s.asked ELSE 1 END, 6) AS fraction, "
    f"{near_zero_sql('coalesce(a.x, s.x) - s.h * cos(coalesce(a.w, 0)) + s.h * sin(coalesce(a.w, 0))')} AS corner_x, {near_zero_sql('coalesce(a.y, s.y) - s.h * sin(coalesce(a.w, 0)) - s.h * cos(coalesce(a.w, 0))')} AS corner_y "
    "FROM s LEFT JOIN f USING (scene_id) LEFT JOIN c ON c.scene_id = s.scene_id AND c.i = coalesce(first_step, steps) LEFT JOIN a ON a.scene_id = s.scene_id AND a.i = coalesce(first_step, steps)"
)
def motion_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Slides and turns of each scene's first object among the others, in substeps, up to the first that fails."""
    p = polygons(spark, sf)
    k = F.col("scene_id")
    asked = F.when(k % 3 == 0, k % 7 * 1.3).otherwise(k % 11 * 37.5)
    degrees = F.when(k % 3 == 0, (k % 4 * 90).cast("double")).otherwise(F.when(k % 2 == 0, 1.0).otherwise(-1.0))
    action = F.element_at(F.array(*map(F.lit, ("TRANSLATE", "ROTATE", "RETRIEVE"))), (k % 3 + 1).cast("int"))
    moves = p.filter("object_id = 1").withColumns({"distance": asked, "degrees": degrees, "action": action})
    out = scene.path_check(moves, p, SHELF, key=["scene_id", "action"], action=F.col("action"), mover=F.col("object_id"))
    corner = F.col("footprint")[0]
    return out.select("scene_id", "action", *(F.col(c).cast("bigint").alias(c) for c in ("steps", "executed", "first_step")), "outside", "hits", r6(F.col("fraction")).alias("fraction"), near_zero(corner["x"]).alias("corner_x"), near_zero(corner["y"]).alias("corner_y"))


GAP = "sqrt(pow(greatest(0, abs(o.x - m.x) - o.h - m.h), 2) + pow(greatest(0, abs(o.y - m.y) - o.h - m.h), 2))"
BEARING = "degrees(atan2(o.y - m.y, o.x - m.x)) - 360 * floor(degrees(atan2(o.y - m.y, o.x - m.x)) / 360)"
#: Whole centres and half sides that are no round numbers, so that neither gaps nor bearings lie on the border of a bin by a rounding.
ODD = "SELECT l_orderkey AS scene_id, l_linenumber AS object_id, CAST(min(l_partkey % 40 - 20) AS DOUBLE) AS x, CAST(min(l_suppkey % 30 - 15) AS DOUBLE) AS y, 1.0371 + 0.05173 * min(l_quantity) AS h FROM lineitem GROUP BY ALL"


def nearest_sql(names: dict[str, float]) -> str:
    return "list_min([" + ", ".join(f"{{'d': abs(bearing - {a} - 360 * floor((bearing - {a} + 180) / 360)), 'i': {i}, 'name': '{n}'}}" for i, (n, a) in enumerate(names.items())) + "]).name"


def odd_squares(spark: SparkSession, sf: str) -> DataFrame:
    li = by_order(spark, sf).groupBy(F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").alias("object_id"))
    s = li.agg(F.min(F.col("l_partkey") % 40 - 20).alias("x"), F.min(F.col("l_suppkey") % 30 - 15).alias("y"), (1.0371 + 0.05173 * F.min("l_quantity")).alias("h"))
    x, y, h = F.col("x"), F.col("y"), F.col("h")
    return s.select("scene_id", "object_id", F.array(G.point(x - h, y - h), G.point(x + h, y - h), G.point(x + h, y + h), G.point(x - h, y + h)).alias("polygon"), G.point(x, y).alias("centre"))


@define(
    f"WITH b AS ({ODD}), m AS (SELECT * FROM b WHERE object_id = 1), e AS (SELECT o.scene_id, o.object_id, {GAP} AS gap, {BEARING} AS bearing FROM b o JOIN m ON o.scene_id = m.scene_id AND o.object_id > 1) "
    f"SELECT scene_id, object_id, round(gap, 1) AS surface_gap_cm, round(bearing, 1) AS center_bearing_deg, {nearest_sql(G.D4)} AS direction_d4, {nearest_sql(G.D8)} AS direction_d8, CASE WHEN gap <= 5 THEN 'CLEARANCE_ZONE_OVERLAP' ELSE 'CLEARANCE_ZONE_CLEAR' END AS clearance_zone FROM e"
)
def relation_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """What stands around each scene's first object; the payloads taken apart again, by object."""
    o = odd_squares(spark, sf)
    out = scene.relation_payloads(o, o.filter("object_id = 1").select("scene_id", F.col("object_id").alias("target_id")))
    rows = out.select("scene_id", F.inline(F.arrays_zip(F.col("R_NUMERIC").alias("n"), F.col("R_QUALITATIVE_D4").alias("f"), F.col("R_QUALITATIVE_D8").alias("e"))))
    return rows.select("scene_id", "n.object_id", "n.surface_gap_cm", "n.center_bearing_deg", F.col("f.center_direction").alias("direction_d4"), F.col("e.center_direction").alias("direction_d8"), "e.clearance_zone")


def levels_sql(value: str, names: list[str], bounds: list[int]) -> str:
    return "CASE " + " ".join(f"WHEN {value} <= {b} THEN '{n}'" for n, b in zip(names, bounds, strict=False)) + f" ELSE '{names[-1]}' END"


TURNS = (
    "tu AS (SELECT m.scene_id, m.object_id, n.name, n.sign, i, m.x, m.y, m.h, radians(n.sign * i * 5) AS w FROM m, (SELECT unnest(['CW', 'CCW']) AS name, unnest([-1, 1]) AS sign) n, range(1, 37) s(i)), a AS (SELECT *, h * (abs(cos(w)) + abs(sin(w))) AS e FROM tu), "
    f"bad AS (SELECT a.scene_id, a.object_id, a.name, min(a.i) AS first FROM a LEFT JOIN b o ON o.scene_id = a.scene_id AND o.object_id <> a.object_id WHERE ({OUTSIDE}) OR (o.h IS NOT NULL AND NOT ({APART})) GROUP BY ALL), "
    "turns AS (SELECT a.scene_id, a.object_id, (coalesce(min(first) FILTER (a.name = 'CW'), 37) - 1) * 5 AS cw, (coalesce(min(first) FILTER (a.name = 'CCW'), 37) - 1) * 5 AS ccw FROM (SELECT DISTINCT scene_id, object_id, name FROM a) a LEFT JOIN bad USING (scene_id, object_id, name) GROUP BY ALL)"
)
NAMES = "CASE degrees " + " ".join(f"WHEN {int(a)} THEN '{n}'" for n, a in G.D4.items()) + " END"


@define(
    f"WITH b AS ({ODD}), m AS (SELECT * FROM b WHERE object_id = 1), {ROOM.format(last=401, step=0.25)}, {TURNS} "
    f"SELECT scene_id, object_id, {NAMES} AS direction, round(free, 1) AS free_space_cm, {levels_sql('free', ['OCCUPIED', 'TIGHT', 'LIMITED', 'OPEN'], [0, 5, 10])} AS free_space_level, CAST(floor(capacity + 1e-9) AS BIGINT) AS max_safe_translation_cm, {levels_sql('capacity', ['NONE', 'SHORT', 'MEDIUM', 'LONG'], [0, 5, 10])} AS max_safe_translation_level, "
    f"CAST(cw AS BIGINT) AS cw, CAST(ccw AS BIGINT) AS ccw, {levels_sql('cw', ['NONE', 'SMALL', 'MEDIUM', 'LARGE'], [0, 15, 45])} AS cw_level FROM room JOIN turns USING (scene_id, object_id)"
)
def motion_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Room, slides and turns of each scene's first object; the payloads taken apart again, by direction."""
    out = scene.motion_payloads(odd_squares(spark, sf), SHELF, G.D4, only=F.col("object_id") == 1)
    each = out.withColumn("direction", F.explode(F.array(*map(F.lit, G.D4))))
    of = lambda c: F.element_at(c, F.col("direction"))
    return each.select(
        "scene_id", "object_id", "direction", of("F_NUMERIC").alias("free_space_cm"), of("F_QUALITATIVE").alias("free_space_level"), of("M_NUMERIC").alias("max_safe_translation_cm"), of("M_QUALITATIVE").alias("max_safe_translation_level"),
        F.col("turn_deg")["CW"].cast("bigint").alias("cw"), F.col("turn_deg")["CCW"].cast("bigint").alias("ccw"), F.col("turn_level")["CW"].alias("cw_level"),
    )


IN_ZONE = "o.h > 0 AND sqrt(pow(greatest(0, abs(o.x - m.x) - o.h - 1.4), 2) + pow(greatest(0, abs(o.y - m.y) - o.h - m.h), 2)) <= 1e-7"


@define(f"WITH b AS ({ODD}), z AS (SELECT scene_id, object_id, unnest(['LEFT', 'RIGHT']) AS side, unnest([x - h - 1.4, x + h + 1.4]) AS x, y, h FROM b) SELECT m.scene_id, m.object_id, m.side, coalesce(list(o.object_id ORDER BY o.object_id) FILTER ({IN_ZONE}), []) AS occupied_by, count(*) FILTER ({IN_ZONE}) = 0 AS free FROM z m LEFT JOIN b o ON o.scene_id = m.scene_id AND o.object_id <> m.object_id GROUP BY ALL")
def finger_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Which objects stand where a gripper's fingers would go, 2.8 cm on both sides of each object."""
    o = odd_squares(spark, sf)
    return scene.finger_zones(o, scene.gripper_zones(o, 2.8)).select("scene_id", "object_id", "side", "occupied_by", "free")


#: Of a gripper, in centimetres: no gap to its zones lies half way between two thousandths, where the engines' roundings differ.
FINGER = 2.800006
ZONE_GAP = f"sqrt(pow(greatest(0, abs(o.x - (m.x {{0}} (m.h + {FINGER / 2}))) - o.h - {FINGER / 2}), 2) + pow(greatest(0, abs(o.y - m.y) - o.h - m.h), 2))"
SIDE = "CASE WHEN count(*) FILTER ({} <= 1e-7) OVER (PARTITION BY scene_id) > 0 THEN 'OCCUPIED' ELSE 'CLEAR' END"


@define(
    f"WITH b AS ({ODD}), m AS (SELECT * FROM b WHERE object_id = 1), e AS (SELECT o.scene_id, o.object_id, {GAP} AS gap, {BEARING} AS bearing, {ZONE_GAP.format('-')} AS l, {ZONE_GAP.format('+')} AS r FROM b o JOIN m ON o.scene_id = m.scene_id AND o.object_id > 1) "
    f"SELECT scene_id, object_id, round(gap, 1) AS surface_gap_cm, round(l, 3) AS left_cm, round(r, 3) AS right_cm, {nearest_sql(G.D4)} AS direction_d4, {nearest_sql(G.D8)} AS direction_d8, CASE WHEN l <= 1e-7 THEN ['LEFT'] ELSE [] END || CASE WHEN r <= 1e-7 THEN ['RIGHT'] ELSE [] END AS zones, {SIDE.format('l')} AS left_status, {SIDE.format('r')} AS right_status, CAST({FINGER} AS DOUBLE) AS width FROM e"
)
def relation_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON documents of what stands around each scene's first object, with its gripper's zones; read back and taken apart by object."""
    o = odd_squares(spark, sf)
    out = scene.relation_documents(o, o.filter("object_id = 1").select("scene_id", F.col("object_id").alias("target_id")), finger_width=FINGER)
    kinds = out.groupBy("scene_id").agg(*(F.first(F.when(F.col("payload") == p, F.col("document")), ignorenulls=True).alias(c) for p, c in (("R_NUMERIC", "n"), ("R_QUALITATIVE_D4", "f"), ("R_QUALITATIVE_D8", "e"))))
    numbers = "gripper struct<required_side_clearance_cm: double>, relations array<struct<object_id: bigint, surface_gap_cm: double, distance_to_finger_placement_zone_cm: struct<LEFT: double, RIGHT: double>>>"
    words = "finger_placement_zone_status struct<LEFT: string, RIGHT: string>, relations array<struct<object_id: bigint, center_direction: string, finger_placement_zones_occupied: array<string>>>"
    read = kinds.select("scene_id", F.from_json("n", numbers).alias("n"), F.from_json("f", words).alias("f"), F.from_json("e", words).alias("e"))
    rows = read.select("scene_id", "f.finger_placement_zone_status", "n.gripper", F.inline(F.arrays_zip(F.col("n.relations").alias("n"), F.col("f.relations").alias("f"), F.col("e.relations").alias("e"))))
    gap, status = F.col("n.distance_to_finger_placement_zone_cm"), F.col("finger_placement_zone_status")
    return rows.select(
        "scene_id", "n.object_id", "n.surface_gap_cm", gap["LEFT"].alias("left_cm"), gap["RIGHT"].alias("right_cm"), F.col("f.center_direction").alias("direction_d4"), F.col("e.center_direction").alias("direction_d8"),
        F.col("f.finger_placement_zones_occupied").alias("zones"), status["LEFT"].alias("left_status"), status["RIGHT"].alias("right_status"), F.col("gripper.required_side_clearance_cm").alias("width"),
    )


CATALOGUE = "SELECT um / 1e6 AS distance, CASE WHEN NOT bool_or(grid) THEN min(scene_id) END AS first_scene FROM (SELECT i * 1000 AS um, true AS grid, NULL AS scene_id FROM range(20, 251, 5) s(i) UNION ALL SELECT CAST(round((0.0213 + 0.0047 * (o_custkey % 50)) * 1e6) AS BIGINT), false, o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY um"


def taught(spark: SparkSession, sf: str) -> DataFrame:
    """A made-up training split: finished orders, each with a distance."""
    o = spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderstatus = 'F'")
    return o.select(F.col("o_orderkey").alias("scene_id"), (0.0213 + 0.0047 * (F.col("o_custkey") % 50)).alias("distance"))


@define(CATALOGUE)
def action_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Every 5 mm from 20 to 250, and the distances of the training split off that grid with the scene that brings them."""
    return scene.action_catalogue(taught(spark, sf))


#: Lengths that no box or grid hits, so that no border hangs on a rounding.
ROOM_GAP, MARGIN = 0.0021373, 0.0103719
MASKS = (
    f"WITH b AS ({BOX}), c AS (SELECT distance FROM ({CATALOGUE})), m AS (SELECT b.*, name AS direction, s FROM b, (SELECT unnest(['LEFT', 'RIGHT']) AS name, unnest([-1, 1]) AS s) WHERE object_id = 1), t AS (SELECT * FROM b WHERE object_id = 2), "
    f"n AS (SELECT m.scene_id, m.direction, 0.3 - {ROOM_GAP} - (s * m.x + m.w / 2) AS room, s * b.x - b.w / 2 - {ROOM_GAP} - (s * m.x + m.w / 2) AS t0, s * b.x + b.w / 2 + {ROOM_GAP} - (s * m.x - m.w / 2) AS t1, abs(m.y - b.y) >= m.w / 2 + b.w / 2 + {ROOM_GAP} AS miss FROM m JOIN b ON m.scene_id = b.scene_id AND b.object_id > 1), "
    'l AS (SELECT scene_id, direction, greatest(0, least(0.45, min(room), min(CASE WHEN NOT miss AND t1 > greatest(t0, 0) THEN greatest(t0, 0) END))) AS "limit" FROM n GROUP BY ALL), '
    f'g AS (SELECT m.scene_id, m.direction, "limit", distance, m.x + s * distance AS gx, m.y, m.w, t.x AS tx, t.y AS ty, t.w AS tw FROM m JOIN t USING (scene_id) JOIN l USING (scene_id, direction), c), '
    f'v AS (SELECT *, distance < "limit" AND abs(gx) + w / 2 <= 0.3 - {ROOM_GAP} AND abs(y) + w / 2 <= 0.3 - {ROOM_GAP} AND greatest(0, least(gx + w / 2, tx + tw / 2 + {MARGIN}) - greatest(gx - w / 2, tx - tw / 2 - {MARGIN})) * greatest(0, least(y + w / 2, ty - tw / 2) - greatest(y - w / 2, -0.3)) <= 1e-10 AS ok FROM g) '
)


@define(MASKS + "SELECT scene_id, direction, count(*) FILTER (ok) AS n_allowed, min(distance) FILTER (ok) AS least, max(distance) FILTER (ok) AS furthest FROM v GROUP BY ALL")
def catalogue_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Which distances of the catalogue each scene's first object may be slid to the left and right, to clear the second one's way out."""
    b = boxes(spark, sf)
    pick = lambda i, name: b.filter(F.col("object_id") == i).select("scene_id", F.col("o").alias(name))
    ways = F.array(*(F.struct(F.lit(n).alias("direction"), F.lit(v).alias("vx"), F.lit(0.0).alias("vy")) for n, v in (("LEFT", -1.0), ("RIGHT", 1.0))))
    moves = pick(1, "blocker").join(pick(2, "target"), "scene_id").select("scene_id", "target", "blocker", F.inline(ways))
    out = scene.catalogue_masks(moves, b.filter("object_id > 2"), scene.action_catalogue(taught(spark, sf)), shelf(), MARGIN, gap=ROOM_GAP)
    return out.select("scene_id", "direction", F.size("allowed").cast("bigint").alias("n_allowed"), F.array_min("allowed").alias("least"), F.array_max("allowed").alias("furthest"))
