"""Components and distances of masks against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from evalquarry.operators import masks


def plain_components(pixels):
    left, out = set(pixels), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            u, v = todo.pop()
            near = {(u + x, v + y) for x in (-1, 0, 1) for y in (-1, 0, 1)} & left
            left -= near
            part |= near
            todo += near
        out.append(part)
    return sorted(out, key=lambda p: (-len(p), min((v, u) for u, v in p)))


def plain_squares(pixels):
    us, vs = [u for u, _ in pixels], [v for _, v in pixels]
    outside = [(x, y) for x in range(min(us) - 1, max(us) + 2) for y in range(min(vs) - 1, max(vs) + 2) if (x, y) not in pixels]
    return {(u, v): min((u - x) ** 2 + (v - y) ** 2 for x, y in outside) for u, v in pixels}


def spiral(n):
    """One long winding path, a pixel wide, with a pixel between its turns."""
    at, step, out = (0, 0), (1, 0), {(0, 0)}
    length = n
    while length > 0:
        for _ in range(2 if length < n else 1):
            for _ in range(length):
                at = (at[0] + step[0], at[1] + step[1])
                out.add(at)
            step = (-step[1], step[0])
        length -= 2
    return out


SHAPES = {
    "frame": {(u, v) for u in range(12) for v in range(9) if u in (0, 1, 11) or v in (0, 8)},
    "spiral": spiral(31),
    "block": {(u, v) for u in range(-4, 7) for v in range(5, 12)},
    "corners": {(i, i) for i in range(20)} | {(40, 40)},
    "pixel": {(3, 3)},
    "comb": {(u, v) for u in range(21) for v in range(15) if u % 2 == 0 or v == 14},
    "halves": {(u, v) for u in range(5) for v in range(2)} | {(u, v) for u in range(5) for v in range(5, 7)},
}
rng = random.Random(7)
for k in range(6):
    SHAPES[f"random{k}"] = {(u, v) for u in range(25) for v in range(20) if rng.random() < 0.25 + 0.1 * k}


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(s, o, u, v) for s, name in enumerate(SHAPES) for o in (1, None) for u, v in SHAPES[name]] + [(0, 1, 0, 0), (0, 1, None, 4)]
    return spark.createDataFrame(rows, "scene_id int, object_id int, u int, v int").repartition(3)


def test_components_of_masks(pixels):
    labelled = masks.labelled_runs(pixels)
    got = {(r.scene_id, r.object_id): r for r in masks.largest_components(labelled).collect()}
    assert len(got) == 2 * len(SHAPES)
    for s, shape in enumerate(SHAPES.values()):
        parts = plain_components(shape)
        best = parts[0]
        for o in (1, None):
            r = got[s, o]
            assert (r.components, r.visible_area, r.area) == (len(parts), len(shape), len(best))
            assert tuple(r.component) == min((v, u) for u, v in best)
            us, vs = [u for u, _ in best], [v for _, v in best]
            assert (r.left, r.top, r.width, r.height) == (min(us), min(vs), max(us) - min(us) + 1, max(vs) - min(vs) + 1)
            assert (r.u_mean, r.v_mean) == pytest.approx((sum(us) / len(us), sum(vs) / len(vs)))
    assert masks.largest_components(masks.labelled_runs(pixels.limit(0))).count() == 0


def test_distances_are_exact(pixels):
    got = {}
    for r in masks.distance_transform(pixels.filter("object_id = 1")).collect():
        got.setdefault(r.scene_id, {})[r.u, r.v] = r.squared
    for s, shape in enumerate(SHAPES.values()):
        assert got[s] == plain_squares(shape)


def test_deepest_points(pixels):
    got = {r.scene_id: r for r in masks.deepest_points(pixels.filter("object_id = 1")).collect()}
    for s, shape in enumerate(SHAPES.values()):
        squares = plain_squares(plain_components(shape)[0])
        u, v = min(squares, key=lambda p: (-squares[p], p[1], p[0]))
        assert (got[s].u, got[s].v, got[s].clearance) == (u, v, pytest.approx(squares[u, v] ** 0.5))


def test_links_of_a_long_chain(spark):
    n = 600
    links = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(5000, 4000), (4000, 4500), (4500, 4500)], "a long, b long"))
    got = {r.node: r.root for r in masks.components(links).collect()}
    assert got == {i: 0 for i in range(n)} | {4000: 4000, 4500: 4000, 5000: 4000}
    assert masks.components(links.limit(0)).count() == 0
