"""The measures of many polygons at once against those of ``geometry``, and how the queries' scenes are dealt."""

import math
import random

from pyspark.sql import functions as F

from evalquarry.functions import geometry as G
from evalquarry.functions import planar as P
from evalquarry.operators import scene
from evalquarry.plans import value_queries

POLYGON = "array<struct<x:double,y:double>>"
BOUNDS = (-30.0, 30.0, -30.0, 30.0)


def convex(rng, corners, spread=20.0):
    """Corners on a circle, or a point or a side."""
    x, y, r = rng.uniform(-spread, spread), rng.uniform(-spread, spread), rng.uniform(0.5, 8)
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [{"x": x + r * math.cos(a), "y": y + r * math.sin(a)} for a in angles]


def pairs(spark, n=120):
    rng = random.Random(7)
    rows = [(i, convex(rng, rng.randint(1, 6)), convex(rng, rng.randint(1, 6), 12.0)) for i in range(n)]
    square = [{"x": a, "y": b} for a, b in ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0))]
    rows += [(n, square, [{"x": p["x"] + 2, "y": p["y"]} for p in square]), (n + 1, square, square), (n + 2, square, None), (n + 3, None, square), (n + 4, [], square), (n + 5, square, [])]
    return spark.createDataFrame(rows, f"i int, p {POLYGON}, q {POLYGON}").repartition(3).cache()


def close(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_room_is_that_of_geometry(spark):
    df = pairs(spark)
    got = {r.i: r.r for r in df.select("i", P.room(F.col("p"), F.col("q"), [0.0, 45.0, 270.0], BOUNDS).alias("r")).collect()}
    whole = df.filter("size(p) > 0").withColumn("o", F.when(F.size("q") > 0, F.array("q")).otherwise(F.array().cast(f"array<{POLYGON}>")))
    args = F.col("p"), F.col("o")
    want = whole.select("i", *(use(*args, F.lit(a), BOUNDS).alias(f"{n}_{k}") for n, use in (("free", G.free_space), ("slide", G.translation_capacity)) for k, a in enumerate((0.0, 45.0, 270.0))), *(G.rotation_capacity(*args, F.lit(s), BOUNDS).alias(n) for n, s in (("turn_cw", -1.0), ("turn_ccw", 1.0)))).collect()
    assert len(want) == 124
    for r in want:
        bad = {n: (v, got[r.i][n]) for n, v in r.asDict().items() if n != "i" and not close(v, got[r.i][n])}
        assert not bad, (r.i, bad)
    assert all(v is None for i in (123, 124) for v in got[i])


def test_scenes_are_dealt_once(spark, monkeypatch):
    """A task's lines don't grow with the table, and a scene's pairs meet without another shuffle; only their least is shuffled."""
    monkeypatch.setattr(value_queries, "LINES", 500)
    sf = "/root/testdata/sf0.001"
    lines = value_queries.by_order(spark, sf)
    assert lines.rdd.getNumPartitions() == -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = value_queries.motion_capacity(spark, sf)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and plan.count("ENSURE_REQUIREMENTS") == 1 and plan.count("REPARTITION_BY_NUM") == 2
        assert out.count() == scene_count(spark, sf) * 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def scene_count(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"))
    return li.filter("a = 1 AND b > 1").count()


def test_distances_arcs_and_turns_are_those_of_geometry(spark):
    df = pairs(spark)
    origin = F.lit(0.5), F.lit(-0.25)
    got = df.select("i", P.distance(F.col("p"), F.col("q")).alias("apart"), P.around(F.col("p"), *origin, F.col("q"), {"ZONE": F.col("p")}).alias("a"), P.turned_measures(F.col("p"), F.col("i") * 7).alias("m")).collect()
    turned = G.rotated(F.col("p"), F.col("i") * 7)
    both = df.filter("size(p) > 0 AND size(q) > 0")
    want = {r.i: r for r in both.select("i", G.distance(F.col("p"), F.col("q")).alias("apart"), G.occupied_arc(G.point(*origin), F.col("q")).alias("arcs"), G.area(turned).alias("area"), G.centroid(turned).alias("c"), turned[0].alias("first"), F.size(G.hull(F.concat(turned, F.array(G.centroid(turned))))).alias("hull")).collect()}
    assert len(want) == 122
    for r in got:
        if r.i not in want:
            assert r.apart is None
            continue
        w = want[r.i]
        assert close(r.apart, w.apart) and close(r.a.gap, w.apart) and close(r.a.ZONE, w.apart), r.i
        assert [w.arcs[0].start, w.arcs[-1].end] == [round(r.a["first"], 1), round(r.a["last"], 1)] and (len(w.arcs) == 2) == (r.a["first"] > r.a["last"])
        assert all(map(close, (r.m.cx, r.m.cy, r.m.area, r.m.x, r.m.y, r.m.hull_size), (w.c.x, w.c.y, w.area, w.first.x, w.first.y, w.hull))), r.i


def test_polygon_measures_leave_the_jvm_once(spark):
    """No fold over arrays is left, which isn't compiled."""
    from evalquarry.plans import shape_queries

    plan = shape_queries.polygon_measures(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan


def test_small_scenes_are_joined_without_being_written(spark):
    """Rows carry their box once, and only large scenes' are checkpointed."""
    plan = value_queries.convex_polygon_distance(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan and "_box" not in plan
