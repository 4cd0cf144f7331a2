import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalquarry.functions import arrays as A
from evalquarry.functions import binning as B
from evalquarry.functions import cascades as C
from evalquarry.functions import geometry as G
from evalquarry.functions import text as X
from evalquarry.operators import audit, linking, metrics, scene, vectors
from evalquarry.sources import io


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def ints(*values):
    return F.array(*map(F.lit, values)).cast("array<bigint>")


def items(*pairs):
    return F.array(*(F.struct(F.lit(k).cast("bigint").alias("id"), F.lit(v).alias("v")) for k, v in pairs))


def test_first_and_last_of_equal_keys(spark):
    got = items((1, "a"), (2, "b"), (1, "c"), (None, "d"))
    assert [r.v for r in one(spark, A.first_of_key(got, "id"))] == ["a", "b"]
    assert [r.v for r in one(spark, A.last_of_key(got, "id"))] == ["b", "c"]
    assert one(spark, A.map_by(got, "id", "v")) == {1: "c", 2: "b"}
    assert [r.v for r in one(spark, A.others(got, "id", F.lit(1)))] == ["b", "d"]


@pytest.mark.parametrize(
    ("pairs", "errors", "twice", "complete"),
    [
        ([(1, 2, 1), (1, 3, 3), (2, 3, 2)], 0, 0, True),
        ([(2, 1, 1), (1, 3, 3), (2, 3, 2)], 1, 0, False),
        ([(1, 2, 1), (1, 2, 2), (1, 3, 3), (2, 3, 2)], 0, 1, False),
        ([(1, 2, 3), (1, 4, 4), (None, 3, 3)], 3, 0, False),
        ([(1, 2, 1)], 0, 0, False),
    ],
)
def test_pair_maps(spark, pairs, errors, twice, complete):
    df = spark.createDataFrame([(pairs, [1, 2, 3])], "p array<struct<id_a: bigint, id_b: bigint, front_id: bigint>>, ids array<bigint>")
    got = df.select(A.pair_map(F.col("p"), F.col("ids")).alias("m")).select("m.*").first()
    assert (got.errors, got.twice, got.complete) == (errors, twice, complete)
    if complete:
        r = df.select(A.relations_from_pairs(A.pair_map(F.col("p"), F.col("ids"))["fronts"], F.col("ids"), F.lit(1).cast("bigint")).alias("r")).first().r
        assert (r.front, r.behind) == ([3], [2])


def test_masks(spark):
    mask = F.array(*map(F.lit, [True, False, False, False]))
    assert tuple(one(spark, A.mask_counts(mask))) == (1, True, False)
    assert one(spark, A.mirrored_mask(mask)) == [False, False, True, False]
    assert one(spark, A.mirrored_mask(A.mirrored_mask(mask))) == [True, False, False, False]


def test_restricted_truth(spark):
    assert tuple(one(spark, A.restricted(ints(3, 1), ints(1, 2), F.lit("PATH")))) == ([1], True)
    assert tuple(one(spark, A.restricted(ints(3), ints(1, 2), F.lit("PATH")))) == ([], False)
    assert tuple(one(spark, A.restricted(ints(3), ints(1, 2), F.lit("NONE")))) == ([], True)


@pytest.mark.parametrize(("text", "want"), [("visible_ids: [1, 2]\n\na | b\nc|d", ([1, 2], [["a", "b"], ["c", "d"]], None)), ("visible_ids: []\na|b", ([], [["a", "b"]], None)), ("a|b", (None, None, "header")), ("visible_ids: [1]\na|b|c", (None, None, "line 1: expected 2 fields")), (None, (None, None, "header"))])
def test_headed_records(spark, text, want):
    assert tuple(one(spark, X.headed_records(F.lit(text).cast("string"), 2))) == want


def test_blocker_errors(spark):
    cases = [((1, 2), (2, 1), "set_exact"), ((), (1,), "false_positive_ids"), ((1,), (), "missed_all_ids"), ((1,), (2,), "wrong_replacement_ids"), ((1, 2), (2, 3), "partial_or_extra_ids")]
    for expected, given, want in cases:
        assert one(spark, C.blocker_set_error(ints(*expected), ints(*given))) == want
    null = F.lit(None).cast("bigint")
    assert [one(spark, C.blocker_error(ints(*v), g)) for v, g in (((), null), ((), F.lit(1)), ((1,), null), ((1,), F.lit(2)), ((1,), F.lit(1)))] == [None, "false_positive", "null_miss", "wrong_id", None]
    yes, none = F.lit(True), F.lit(None).cast("boolean")
    assert one(spark, C.action_error(F.lit(False), yes, yes, yes, none, F.lit(False))) == "DISTANCE_WRONG"
    assert one(spark, C.action_error(none, yes, yes, yes, none, none)) == "PHYSICAL_FAILURE_AFTER_GT_MATCH"


def test_ranges(spark):
    df = spark.createDataFrame([(0.5, 0.25), (0.76, 0.3), (None, 0.3)], "visible_target_fraction double, blocker_occlusion_fraction double")
    assert [r[0] for r in df.select(B.within(B.ACCEPTED)).collect()] == [True, False, False]


def test_audits(spark):
    universe, splits = spark.createDataFrame([(i,) for i in range(4)], "k int"), spark.createDataFrame([(0, "a"), (1, "a"), (1, "b"), (9, "b")], "k int, s string")
    assert {(r.k, r.fault) for r in audit.split_cover(universe, splits, "k", "s").collect()} == {(1, "overlap"), (2, "missing"), (3, "missing"), (9, "unknown")}
    rows = audit.cross_metric(splits, ["s"], {"n": (F.count("*"), F.max("k"))}).collect()
    assert {(r.s, r.one, r.other) for r in rows} == {("a", 2.0, 1.0), ("b", 2.0, 9.0)}
    assert [r.k for r in audit.pending_first(universe, splits, ["k"], [F.desc("k")], 1).collect()] == [3]
    got = metrics.rounded_delta(spark.createDataFrame([(i < 1, i < 2) for i in range(3)], "b boolean, a boolean"), F.col("b"), F.col("a")).first()
    assert (got.before_pct, got.after_pct, got.delta_pp) == (33.333, 66.667, 33.334)


def test_validity(spark):
    no, yes = F.lit(False), F.lit(True)
    valid = linking.action_validity
    assert one(spark, valid(yes, yes, yes, no, no, no, no)) and one(spark, valid(no, no, no, yes, yes, no, no))
    assert not one(spark, valid(yes, yes, yes, no, no, yes, no)) and not one(spark, valid(no, no, no, yes, F.lit(None).cast("boolean"), no, no))


def test_finger_zones(spark):
    square = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]
    kind = "array<struct<x: double, y: double>>"
    objects = spark.createDataFrame([(1, 1, square(0.0)), (1, 2, square(2.0)), (2, 3, square(2.0))], f"scene_id int, object_id int, polygon {kind}")
    zones = spark.createDataFrame([(1, 1, "left", square(-1.0)), (1, 1, "right", square(1.0)), (2, 3, "left", square(9.0))], f"scene_id int, object_id int, side string, zone {kind}")
    got = {(r.scene_id, r.side): (r.occupied_by, r.free) for r in scene.finger_zones(objects, zones).collect()}
    assert got == {(1, "left"): ([], True), (1, "right"): ([2], False), (2, "left"): ([], True)}


def test_segment_distance(spark):
    seg = lambda a, b: F.struct(G.point(*map(F.lit, a)).alias("a"), G.point(*map(F.lit, b)).alias("b"))
    assert one(spark, G.segment_distance(seg((0.0, 0.0), (2.0, 2.0)), seg((0.0, 2.0), (2.0, 0.0)))) == 0
    assert one(spark, G.segment_distance(seg((0.0, 0.0), (1.0, 0.0)), seg((1.0, 0.0), (2.0, 5.0)))) == 0
    assert one(spark, G.segment_distance(seg((0.0, 0.0), (1.0, 0.0)), seg((4.0, 4.0), (4.0, 9.0)))) == 5
    assert one(spark, G.segment_distance(seg((0.0, 0.0), (0.0, 0.0)), seg((3.0, 4.0), (3.0, 4.0)))) == 5


def test_losses(spark):
    logits, ok = F.array(*map(F.lit, [1.0, 2.0, 0.0])), F.array(*map(F.lit, [True, False, True]))
    assert one(spark, vectors.acceptable_nll(logits, F.array(*[F.lit(True)] * 3))) == pytest.approx(0)
    assert one(spark, vectors.acceptable_nll(logits, F.array(*[F.lit(False)] * 3))) is None
    assert one(spark, vectors.ranking_loss(logits, ok, 0.5)) == pytest.approx(1.5)
    assert one(spark, vectors.smooth_l1(F.lit(0.5))) == pytest.approx(0.125) and one(spark, vectors.smooth_l1(F.lit(-3.0))) == pytest.approx(2.5)


def test_malformed_lines_are_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(['{"x": 1}', "", '{"x": 2}']))
    assert sorted(r.x for r in io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n{"x": \n')
    with pytest.raises(Exception, match=r"malformed JSON at .*b\.jsonl:4"):
        io.read_jsonl(spark, str(tmp_path), "x int").collect()
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    (tmp_path / "long.txt").write_text("".join(f"line {i}\n" for i in range(1, 2001)))
    try:
        spark.conf.set(key, "3000b")
        lines = io.numbered_lines(spark, str(tmp_path / "long.txt"))
        assert all(r.value == f"line {r.line}" for r in lines.collect()) and lines.count() == 2000
    finally:
        spark.conf.set(key, before)


def test_documents_of_reports(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "é")], "b int, a string")
    io.write_document(df, str(tmp_path / "r"), sort_keys=True)
    (part,) = (tmp_path / "r").glob("part-*")
    text = part.read_text()
    assert json.loads(text) == [{"a": None, "b": 2}, {"a": "é", "b": 1}] and text.count("\n") > 3
    with pytest.raises(ValueError, match="no report"):
        io.write_document(df, str(tmp_path / "s"), most=1)


def boxed(spark, rows):
    """Objects (scene, id, x0, y0, x1, y1) as boxes."""
    df = spark.createDataFrame(rows, "scene_id string, object_id long, xmin double, ymin double, xmax double, ymax double")
    return df.select("scene_id", "object_id", F.struct("xmin", "ymin", "xmax", "ymax").alias("box"))


@pytest.mark.parametrize("small", [0, 40, 10_000])
@pytest.mark.parametrize("within", [0.0, 0.3, 5.0])
def test_boxes_of_all_sizes_meet_once(spark, within, small):
    rng = random.Random(12)

    def some(n):
        out = []
        for i in range(n):
            x, y, w, h = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.0, 0.01, 1.0, 8.0, 70.0]) * rng.random(), rng.choice([0.0, 0.2, 2.0, 30.0]) * rng.random()
            out.append((rng.choice(["a", "a", "a", "b", None]), i, x, y, x + w, y + h))
        return [*out, ("a", n, 1.0, 1.0, None, 2.0), ("a", n + 1, 2.0, 2.0, 4.0, 4.0), ("a", n + 2, 4.0, 4.0, 4.0, 8.0)]

    left, right = some(120), some(100)
    got = Counter((r.object_id, r.object_id_o) for r in scene.meeting_boxes(boxed(spark, left), boxed(spark, right), within=within, small=small, suffixes=("", "_o")).collect())
    near = lambda p, q, k: p[k] - within <= q[k + 2] and q[k] <= p[k + 2] + within
    whole = lambda rows: [r for r in rows if None not in r]
    assert got == Counter((p[1], q[1]) for p in whole(left) for q in whole(right) if p[0] == q[0] and near(p, q, 2) and near(p, q, 3))


def test_a_scene_of_many_objects_is_dealt_by_cells(spark):
    n = 150
    grid = spark.range(n * n).select(F.lit(1).alias("scene_id"), F.col("id").alias("object_id"), (F.col("id") % n * 1.0).alias("x"), (F.floor(F.col("id") / n) * 1.0).alias("y"))
    polygon = F.array(*(F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in ((0, 0), (0.5, 0), (0.5, 0.5), (0, 0.5))))
    near = scene.near_objects(grid.select("scene_id", "object_id", polygon.alias("polygon")), 0.55)
    plan = near._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    cells = [line for line in joins if "_x_a" in line]
    assert cells and all("_y_a" in line and "_l_a" in line for line in cells)  # the cells are keys, and no distance is in a join
    assert "sqrt" not in " ".join(joins).lower()
    assert near.count() == 2 * n * (n - 1)


def test_fingers_beside_a_target(spark):
    square = lambda x, y: [(x, y), (x + 1.0, y), (x + 1.0, y + 1.0), (x, y + 1.0)]
    rows = [(1, 1, square(0.0, 0.0)), (1, 2, square(1.5, 0.9)), (1, 3, square(-3.2, 0.0)), (1, 4, square(0.0, 1.2)), (2, 1, square(0.0, 0.0))]
    df = spark.createDataFrame(rows, "scene_id int, object_id int, polygon array<struct<x: double, y: double>>")
    zones = scene.gripper_zones(df.filter("object_id = 1"), 2.0)
    assert {(r.side, min(p.x for p in r.zone), max(p.x for p in r.zone), max(p.y for p in r.zone)) for r in zones.collect()} == {("LEFT", -2.0, 0.0, 1.0), ("RIGHT", 1.0, 3.0, 1.0)}
    got = {(r.scene_id, r.side): (r.occupied_by, r.free) for r in scene.finger_zones(df, zones).collect()}
    assert got == {(1, "LEFT"): ([], True), (1, "RIGHT"): ([2], False), (2, "LEFT"): ([], True), (2, "RIGHT"): ([], True)}
