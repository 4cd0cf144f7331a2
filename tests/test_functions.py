"""Column functions against known answers and plain Python."""

import hashlib
import itertools
import json
import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from evalquarry.functions import arrays as A
from evalquarry.operators import orders
from evalquarry.functions import binning as B
from evalquarry.functions import geometry as G
from evalquarry.functions import text as X


def one(spark, *columns):
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    return row[0] if len(columns) == 1 else tuple(row)


def lit(values, kind="bigint"):
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def poly(points):
    return F.array(*(G.point(F.lit(float(x)), F.lit(float(y))) for x, y in points))


def square(x, y, half):
    return [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half)]


def test_bins_are_right_and_left_closed(spark):
    assert one(spark, *(B.translation_level(F.lit(v)) for v in (-1.0, 0.0, 0.1, 5.0, 5.1, 10.0, 10.1))) == ("NONE", "NONE", "SHORT", "SHORT", "MEDIUM", "MEDIUM", "LONG")
    assert one(spark, *(B.distance_bin(F.lit(v)) for v in (1.9, 2.0, 5.0, 9.0, 25.0, 25.1))) == (None, "short", "medium", "long", "long", None)
    assert one(spark, B.free_space_level(F.lit(10.0)), B.rotation_level(F.lit(15.0)), B.rotation_level(F.lit(46.0))) == ("LIMITED", "SMALL", "LARGE")


def test_classifiers(spark):
    assert one(spark, B.first_match([(F.lit(None).cast("boolean"), "a"), (F.lit(True), "b")], "c")) == "b"
    assert one(spark, B.side_class(lit([], "string")), B.side_class(lit(["left"], "string")), B.side_class(lit(["left", "right"], "string"))) == ("all_left", "all_left", "mixed")
    assert one(spark, B.guarded_label(F.lit("x"), ["a"]), B.guarded_label(F.lit(None).cast("string"), ["a"]), B.guarded_label(F.lit("a"), ["a"], F.lit(False))) == ("INVALID", "INVALID", "INVALID")
    assert one(spark, B.condition_key(F.lit("C0"), F.lit(None).cast("string")), B.condition_key(F.lit("C2"), F.lit("D4"))) == ("C0", "C2_D4")
    assert one(spark, B.violations({"a": F.lit(True), "b": F.lit(False), "c": F.lit(None).cast("boolean")})) == ["b", "c"]
    with pytest.raises(Exception, match="no class for"):
        one(spark, B.prefix_class(F.lit("zz"), {"a": "A"}))


def test_text(spark):
    assert one(spark, X.normalized(F.lit("  The Red-Mug, no. 5! "))) == "the red mug no 5"
    assert one(spark, X.phrase_matches(F.lit("a red mugs"), lit(["Red Mug"], "string")), X.phrase_matches(F.lit("A RED, mug"), lit(["red mug"], "string"))) == (False, True)
    assert one(spark, X.int_list(F.lit("17, 42 ,86")), X.int_list(F.lit("17,")), X.int_list(F.lit("x"))) == ([17, 42, 86], None, None)
    assert one(spark, X.seed64(F.lit("abc"))) == int.from_bytes(hashlib.sha256(b"abc").digest()[:8], "big")
    assert one(spark, X.filled("take {a} from {b}", {"a": F.lit(1), "b": F.lit("x")})) == "take 1 from x"
    assert one(spark, X.common_prefix_length(lit([1, 2, 3]), lit([1, 2, 4])), X.common_prefix_length(lit([1]), lit([1, 2]))) == (2, 1)
    assert one(spark, X.percent(F.lit(0.125)), X.percent(F.lit(None).cast("double"))) == ("12.5%", "n/a")
    assert one(spark, X.stable_rank(F.lit("a"), F.lit(2))) == hashlib.sha256(b"a\x002").hexdigest()


@pytest.mark.parametrize(("raw", "error"), [('{"a": 1, "b": [2]}', None), ("{", "not_json"), (None, "not_json"), ("[1]", "not_object"), ('{"a": 1}', "keys"), ('{"a": 1, "b": [2], "c": 0}', "keys"), ('{"a": true, "b": [2]}', "type"), ('{"a": 1.5, "b": [2]}', "type")])
def test_strict_json(spark, raw, error):
    assert one(spark, X.strict_json(F.lit(raw).cast("string"), "a bigint, b array<bigint>", ["a", "b"])["error"]) == error


def test_pipe_records(spark):
    good = one(spark, X.pipe_records(F.lit("a | 1\n\n b|2 "), 2))
    assert good.records == [["a", "1"], ["b", "2"]] and good.error is None
    assert one(spark, X.pipe_records(F.lit("a|1\n\nb"), 2)).error == "line 2: expected 2 fields"


def test_canonical_json(spark):
    assert one(spark, X.canonical_map_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))) == json.dumps({"a": 2, "b": 1}, separators=(",", ":"))


def test_multisets(spark):
    a, b = [1, 1, 2, 3, 3, 3], [1, 3, 3, 4]
    got = one(spark, A.multiset_scores(lit(a), lit(b)))
    ca, cb = Counter(a), Counter(b)
    assert (got.tp, got.fp, got.fn) == (sum((ca & cb).values()), sum((cb - ca).values()), sum((ca - cb).values()))
    assert got.missing == sorted((ca - cb).elements()) and got.extra == sorted((cb - ca).elements())
    assert tuple(one(spark, A.set_scores(lit(a), lit(b)))) == (2, 1, 1, False)


def test_orders(spark):
    got = one(spark, A.order_agreement(lit([1, 2, 3, 4]), lit([2, 1, 4])))
    assert (got.agree, got.total) == (2, 6)
    r = one(spark, A.relations(lit([5, 6, 7]), F.lit(6)))
    assert (r.front, r.behind) == ([5], [7])
    assert tuple(one(spark, A.relation_agreement(lit([1, 2, 3, 4]), lit([4, 2, 3]), F.lit(2)))) == (1, 3)
    assert one(spark, A.sparse_ids(lit([5, 9, 7])), A.sparse_ids(lit([5, 6])), A.sparse_ids(lit([]))) == (True, False, True)


def test_best_orders(spark):
    rng = random.Random(9)
    cases = [([3, 1, 2, 4], [(1, 2), (2, 3), (3, 1), (1, 4), (2, 4), (3, 4)]), ([], [(1, 2)]), ([7], []), ([2, 1, 3], []), ([5, 9], [(9, 5), (9, 5), (5, 9), (9, 77)]), (None, []), ([1, 2], None)]
    for n in (5, 6, 7):
        ids = rng.sample(range(50), n)
        cases.append((ids, [tuple(rng.sample(ids, 2)) for _ in range(3 * n)]))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, ids array<bigint>, votes array<struct<a: bigint, b: bigint>>")
    got = orders.kemeny(df, F.col("ids"), F.col("votes"), "k", every=True).collect()
    assert {r.i: r.k and r.k[:3] for r in got} == {r.i: r.k and tuple(r.k) for r in orders.kemeny(df, F.col("ids"), F.col("votes"), "k").collect()}
    for r in got:
        ids, votes = cases[r.i]
        if ids is None:
            assert r.k is None
            continue
        score = lambda o: sum(a in o and b in o and o.index(a) < o.index(b) for a, b in votes or [])  # noqa: E731, B023
        tried = list(itertools.permutations(sorted(ids)))
        top = max(map(score, tried))
        best = [o for o in tried if score(o) == top]
        assert [tuple(o) for o in r.k.orders] == best
        assert (r.k.kept, r.k.n_best, tuple(r.k.first)) == (top, len(best), best[0])


def test_best_orders_of_twelve_ids_and_of_more(spark):
    planted = [3, 11, 0, 7, 5, 1, 10, 2, 9, 8, 4, 6]
    votes = [(a, b) for a, b in itertools.combinations(planted, 2)] * 2 + [(b, a) for a, b in itertools.combinations(planted, 2)]
    one_row = lambda ids, pairs: spark.createDataFrame([(ids, pairs)], "ids array<int>, votes array<struct<a: int, b: int>>")
    best = lambda df, every=False: orders.kemeny(df, F.col("ids"), F.col("votes"), every=every).first().best
    r = best(one_row(list(range(12)), votes))
    assert (r.kept, r.n_best, r.first) == (132, 1, planted)
    free = best(one_row(list(range(12)), []))
    assert (free.n_best, free.first) == (math.factorial(12), list(range(12)))
    with pytest.raises(Exception, match="13 ids are more than 12"):
        best(one_row(list(range(13)), []))
    with pytest.raises(Exception, match="best orders are more"):
        best(one_row(list(range(9)), []), every=True)


def test_query_rule(spark):
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert one(spark, A.query_rule(t, f, t, n, t), A.query_rule(t, f, t, t, t), A.query_rule(f, t, n, f, f), A.query_rule(t, t, t, f, f), A.query_rule(t, t, t, n, t)) == (True, False, True, True, False)


def test_angles(spark):
    assert one(spark, G.angular_distance(F.lit(350.0), F.lit(10.0)), G.angular_distance(F.lit(10.0), F.lit(350.0))) == (20.0, 20.0)
    assert one(spark, G.nearest_direction(F.lit(45.0), G.D4), G.nearest_direction(F.lit(-1.0), G.D8), G.nearest_direction(F.lit(200.0), G.D8)) == ("RIGHT", "RIGHT", "LEFT")
    assert one(spark, G.bearing(F.lit(0.0), F.lit(-1.0))) == pytest.approx(270)


def test_no_room_but_for_a_rounding(spark):
    """Two equal squares, the other centre within: the ray leaves the other at the polygon's own rim."""
    from evalquarry.operators import scene

    h = 1.0371 + 0.05173 * 44
    rows = [(1, i, [{"x": x + a * h, "y": -11.0 + b * h} for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]) for i, x in ((1, 5.0), (7, 2.0))]
    o = spark.createDataFrame(rows, "scene_id int, object_id int, polygon array<struct<x:double,y:double>>")
    (r,) = scene.motion_payloads(o, (-30.0, 30.0, -30.0, 30.0), G.D4, only=F.col("object_id") == 1).collect()
    assert r.F_NUMERIC["BACK"] == r.F_NUMERIC["FRONT"] == 0 and r.F_QUALITATIVE["BACK"] == r.F_QUALITATIVE["FRONT"] == "OCCUPIED"


def test_angular_bins_on_the_sectors_borders(spark, tmp_path):
    """Each balance lies half way between two directions, where the SQL takes the next one."""
    from evalquarry.plans import catalog

    balances = [45.0, 135.0, 225.0, 315.0, 765.0, -45.0, -315.0, 44.99, 45.01, 0.0]
    spark.createDataFrame(list(enumerate(balances)), "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {tuple(r) for r in catalog.QUERIES["angular_bins"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
        assert got == set(con.execute(catalog.SQL["angular_bins"]).fetchall())


def test_polygons(spark):
    s = square(0, 0, 1)
    c = one(spark, G.centroid(poly([(0, 0), (4, 0), (0, 3)])))
    assert (c.x, c.y) == pytest.approx((4 / 3, 1))
    assert one(spark, G.area(poly(s))) == 4
    assert one(spark, G.intersects(poly(s), poly(square(2, 0, 1))), G.intersects(poly(s), poly(square(2.1, 0, 1)))) == (True, False)
    assert one(spark, G.distance(poly(s), poly(square(5, 6, 1)))) == pytest.approx(5)
    assert one(spark, G.distance(poly(s), poly([(2, -5), (2, 5), (9, 0)]))) == pytest.approx(1)
    assert one(spark, G.inside(poly(s), (-1, 1, -1, 1)), G.inside(poly(s), (-1, 0.9, -1, 1))) == (True, False)
    hull = one(spark, G.hull(poly([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 0), (0, 0)])))
    assert [(p.x, p.y) for p in hull] == [(0, 0), (2, 0), (2, 2), (0, 2)]
    turned = one(spark, G.rotated(poly(s), F.lit(90)))
    assert [(round(p.x, 9), round(p.y, 9)) for p in turned] == [(1, -1), (1, 1), (-1, 1), (-1, -1)]


def test_motion(spark):
    bounds = (-20.0, 20.0, -20.0, 20.0)
    s, wall = poly(square(0, 0, 1)), F.array(poly(square(8, 0, 1)))
    assert one(spark, G.free_space(s, wall, F.lit(0.0), bounds)) == pytest.approx(6)
    assert one(spark, G.free_space(s, wall, F.lit(180.0), bounds)) == pytest.approx(19)
    assert one(spark, G.translation_capacity(s, wall, F.lit(0.0), bounds)) == 5.75
    assert one(spark, G.translation_capacity(s, wall, F.lit(90.0), bounds)) == 19
    assert one(spark, G.rotation_capacity(s, F.array(poly(square(2.3, 0, 1))), F.lit(1), bounds)) == 20
    assert one(spark, G.rotation_capacity(s, F.array(poly(square(5, 0, 1))), F.lit(-1), bounds)) == 180


def steps(a, others, degrees, bounds, step, most):
    """Translation capacity step by step."""
    import numpy as np

    def meet(p, q):
        for r in (p, q):
            for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1], strict=True):
                n = (-(y1 - y0), x1 - x0)
                u, v = [x * n[0] + y * n[1] for x, y in p], [x * n[0] + y * n[1] for x, y in q]
                if max(u) < min(v) - 1e-7 or max(v) < min(u) - 1e-7:
                    return False
        return True

    dx, dy = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    safe = 0.0
    for i in np.arange(1, round(most / step) + 1):
        moved = [(x + dx * i * step, y + dy * i * step) for x, y in a]
        if any(not (bounds[0] - 1e-7 <= x <= bounds[1] + 1e-7 and bounds[2] - 1e-7 <= y <= bounds[3] + 1e-7) for x, y in moved) or any(meet(moved, o) for o in others):
            break
        safe = i * step
    return safe


def test_capacity_agrees_with_stepping(spark):
    import random

    rng = random.Random(3)
    bounds = (-30.0, 30.0, -30.0, 30.0)
    cases, columns = [], []
    for _ in range(12):
        a = square(rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(0.5, 3))
        others = [[(x + 0.3 * y, y) for x, y in square(rng.uniform(-25, 25), rng.uniform(-25, 25), rng.uniform(0.5, 4))] for _ in range(4)]
        degrees = rng.choice([0.0, 45.0, 90.0, 200.0, 270.0, 301.0])
        cases.append(steps(a, others, degrees, bounds, 0.25, 40.0))
        columns.append(G.translation_capacity(poly(a), F.array(*map(poly, others)), F.lit(degrees), bounds, most=40.0))
    assert one(spark, *columns) == tuple(cases)


def test_arcs(spark):
    arcs = one(spark, G.occupied_arc(G.point(F.lit(0), F.lit(0)), poly([(2, -1), (3, -1), (3, 1), (2, 1)])))
    assert [(a.start, a.end) for a in arcs] == [(333.4, 360.0), (0.0, 26.6)]
    up = G.occupied_arc(G.point(F.lit(0), F.lit(0)), poly([(-1, 2), (1, 2), (0, 3)]))
    assert [(a.start, a.end) for a in one(spark, up)] == [(63.4, 116.6)]
    assert one(spark, G.occupied_directions(up, G.D4)) == ["BACK"] or "BACK" in one(spark, G.occupied_directions(up, G.D4))
    assert one(spark, G.in_arcs(F.lit(350.0), F.array(F.struct(F.lit(5.0).alias("start"), F.lit(20.0).alias("end"))), 22.5)) is True


def test_rectangles(spark):
    r = G.rect(*(F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)))
    o = G.rect(*(F.lit(v) for v in (2.0, 0.5, 3.0, 1.5)))
    assert one(spark, G.contact(r, F.lit(1.0), F.lit(0.0), o, 0.1)) == pytest.approx(0.9)
    assert one(spark, G.contact(r, F.lit(-1.0), F.lit(0.0), o, 0.1)) is None
    assert one(spark, G.contact(r, F.lit(0.0), F.lit(1.0), o, 0.1)) is None
    assert one(spark, G.overlap(r, G.moved(r, F.lit(0.5), F.lit(0.25)))) == pytest.approx(0.375)


def broken(spark, rules):
    return one(spark, B.violations(rules))


def test_response_rules(spark):
    from evalquarry.functions import rules as R

    see, t = lit([10, 20, 30]), F.lit(20)
    none, text = F.lit(None).cast("bigint"), lambda s: F.lit(s)
    assert broken(spark, R.visibility_rules(F.lit(False), text("FULL"))) == ["not found but visible"]
    assert broken(spark, R.visibility_rules(F.lit(True), text("NOT_VISIBLE"))) == ["found but not visible"]
    assert broken(spark, R.ordered_assessment_rules(lit([30, 10]), lit([True, False], "boolean"), lit([30, 20, 10]), t, t)) == []
    assert broken(spark, R.ordered_assessment_rules(lit([10, 30]), lit([True, None], "boolean"), lit([30, 20, 10]), t, F.lit(1))) == ["names another target", "objects out of order, missing or extra", "a flag is no Boolean"]
    fine = ["INTERFERES", "TARGET", "DOES_NOT_INTERFERE"]
    assert broken(spark, R.relation_rules(lit([10, 20, 30]), lit(fine, "string"), see, t, t)) == []
    assert broken(spark, R.relation_rules(lit([20, 10, 30]), lit(fine, "string"), see, t, t)) == ["not ascending", "the target has another relation", "another object's relation"]
    assert broken(spark, R.blocker_rules(text("NONE"), none, see, t)) == []
    assert broken(spark, R.blocker_rules(text("NONE"), F.lit(20), see, t)) == ["no reason but a blocker", "chosen object is the target"]
    assert broken(spark, R.blocker_rules(text("FRONT"), none, see, t)) == ["a reason but no blocker"]
    assert broken(spark, R.blocker_set_rules(text("FRONT"), lit([10, 30]), see, t)) == []
    assert broken(spark, R.blocker_set_rules(text("NONE"), lit([30, 10, 10, 99]), see, t)) == ["a blocker twice", "blockers not ascending", "a blocker isn't visible", "no reason but blockers"]
    act = lambda a, c, d=None, dl=None: R.action_rules(text(a), F.lit(c), see, t, F.lit(d).cast("double"), F.lit(dl).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("string"))
    assert broken(spark, act("RETRIEVE", 20)) == [] and broken(spark, act("RETRIEVE", 10)) == ["retrieves another object"]
    assert broken(spark, act("TRANSLATE", 20, 4.0, "LONG")) == ["moves the target", "distance and its level differ"]
    assert broken(spark, R.upstream_rules(text("RETRIEVE"), F.lit(20), t, text("FRONT"), F.lit(10))) == ["retrieves in spite of a blocker", "moves another object than the blocker"]
    assert broken(spark, R.action_only_rules(text('{"action": "FLY", "x": 1}'), text("FLY"))) == ["other keys than action", "unknown action"]
