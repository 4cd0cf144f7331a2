"""Masks as pixel tables (u to the right, v down): connected components by runs, and distances to the background."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stable import checkpointed

MASK = ("scene_id", "object_id")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the least node of its component.

    In a round every node goes to the neighbour, or stays itself, that comes first in
    a random order, and the links are carried along; about half of the nodes are left,
    on long chains too. The orders are hashes with the round's number, so reruns agree. The
    rounds' moves, ever fewer, are put together from the last one back.
    """
    edges = checkpointed(links.select("a", "b").filter("a <> b").distinct())
    moves = []
    while not edges.isEmpty():
        turn = len(moves)
        place = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(place("b")).alias("least"))
        moves.append(checkpointed(first.select(F.col("a").alias("node"), F.least("least", place("a"))["n"].alias("to"))))
        ends = [moves[-1].select(F.col("node").alias(c), F.col("to").alias(f"_{c}")) for c in ("a", "b")]
        moved = edges.join(ends[0], "a").join(ends[1], "b").filter("_a <> _b")
        edges = checkpointed(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    ends = moves.pop()
    while moves:
        later = ends.select(F.col("node").alias("to"), F.col("to").alias("_end"))
        ends = moves.pop().join(later, "to", "left").select("node", F.coalesce("_end", "to").alias("to"))
    least = ends.groupBy("to").agg(F.min("node").alias("root"))
    return ends.join(least, "to").select("node", "root")


def runs(pixels: DataFrame, by: Sequence[str] = MASK) -> DataFrame:
    """Each row's runs of neighbouring pixels: by, v, u0, u1. Repeated pixels count once; pixels without a place aren't any."""
    of_row = Window.partitionBy(*by, "v").orderBy("u")
    islands = pixels.select(*by, F.col("u").cast("long"), F.col("v").cast("long")).dropna(subset=["u", "v"]).distinct().withColumn("_i", F.col("u") - F.row_number().over(of_row))
    return islands.groupBy(*by, "v", "_i").agg(F.min("u").alias("u0"), F.max("u").alias("u1")).drop("_i")


def labelled_runs(pixels: DataFrame, by: Sequence[str] = MASK) -> DataFrame:
    """The runs with component, the place (v, u) where the first run of their component begins.

    Runs of neighbouring rows that touch, corners too, are linked, so the search goes over runs and
    not over pixels, whatever their shape; masks of all scenes are searched at once.
    """
    found = checkpointed(runs(pixels, by).withColumn("_run", F.struct(*by, "v", "u0")))
    a, b = (found.select(*(F.col(c).alias(f"{c}_{x}") for c in (*by, "v", "u0", "u1")), F.col("_run").alias(x)) for x in "ab")
    same = [F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in by]
    touch = (F.col("v_a") + 1 == F.col("v_b")) & (F.col("u0_a") <= F.col("u1_b") + 1) & (F.col("u0_b") <= F.col("u1_a") + 1)
    for c in same:
        touch = touch & c
    roots = components(a.join(b, touch).select("a", "b")).withColumnRenamed("node", "_run")
    out = found.join(roots, found["_run"].eqNullSafe(roots["_run"]), "left").select(found["*"], "root")
    first = F.coalesce("root", found["_run"])
    return out.withColumn("component", F.struct(first["v"].alias("v"), first["u0"].alias("u"))).drop("_run", "root")


def component_summary(labelled: DataFrame, by: Sequence[str] = MASK) -> DataFrame:
    """Of labelled_runs, for each component: area, centroid and bounding box."""
    n = F.col("u1") - F.col("u0") + 1
    area = F.sum(n)
    return labelled.groupBy(*by, "component").agg(
        area.alias("area"), (F.sum((F.col("u0") + F.col("u1")) / 2 * n) / area).alias("u_mean"), (F.sum(F.col("v") * n) / area).alias("v_mean"),
        F.min("u0").alias("left"), F.min("v").alias("top"), (F.max("u1") - F.min("u0") + 1).alias("width"), (F.max("v") - F.min("v") + 1).alias("height"),
    )


def largest_components(labelled: DataFrame, by: Sequence[str] = MASK) -> DataFrame:
    """Of labelled_runs, for each mask: components, visible_area of all, and its largest component (ties: the one that begins first)."""
    each = component_summary(labelled, by)
    rest = [c for c in each.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct("area", (-F.col("component.v")).alias("v"), (-F.col("component.u")).alias("u")))
    return each.groupBy(*by).agg(F.count("*").alias("components"), F.sum("area").alias("visible_area"), best.alias("_best")).select(*by, "components", "visible_area", "_best.*")


def squared_distances(across: list[int]) -> list[int]:
    """For a column's run of pixels with their distances to the background along the row: the squared distance to any background pixel.

    Over place x, pixel i gives the parabola across[i]^2 + (x - i)^2; the background
    above and below gives those of 0. The lower envelope is built from left to right:
    a new parabola drops those that it undercuts before they begin.
    """
    heights = [0, *(g * g for g in across), 0]
    kept, begins = [0], [float("-inf")]
    for i in range(1, len(heights)):
        while True:
            j = kept[-1]
            at = (heights[i] + i * i - heights[j] - j * j) / (2 * (i - j))
            if at > begins[-1]:
                break
            kept.pop()
            begins.pop()
        kept.append(i)
        begins.append(at)
    out, k = [], 0
    for x in range(1, len(heights) - 1):
        while k + 1 < len(kept) and begins[k + 1] <= x:
            k += 1
        out.append(heights[kept[k]] + (x - kept[k]) ** 2)
    return out


def distance_transform(pixels: DataFrame, by: Sequence[str] = MASK) -> DataFrame:
    """by, u, v and squared, the squared Euclidean distance of each pixel's centre to that of the nearest pixel outside the mask.

    Exact, in two passes: along a row the nearer end of the pixel's run says how far
    the background is; the runs of each column then take the least over their rows, each
    one by the lower envelope of its parabolas. A task holds one column's run.
    """
    along = runs(pixels, by).withColumn("u", F.explode(F.sequence("u0", "u1"))).withColumn("g", F.least(F.col("u") - F.col("u0"), F.col("u1") - F.col("u")) + 1)
    of_column = Window.partitionBy(*by, "u").orderBy("v")
    columns = along.withColumn("_i", F.col("v") - F.row_number().over(of_column)).groupBy(*by, "u", "_i").agg(F.min("v").alias("_top"), F.sort_array(F.collect_list(F.struct("v", "g"))).alias("_g"))
    columns = columns.select(*by, "u", "_top", F.transform("_g", lambda x: x["g"]).alias("_g"))

    def envelopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([squared_distances(g) for g in batch.column("_g").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=batch.schema.names)

    out = columns.mapInArrow(envelopes, T.StructType([*columns.schema.fields[:-1], T.StructField("_g", T.ArrayType(T.LongType()))]))
    return out.select(*by, "u", "_top", F.posexplode("_g").alias("_at", "squared")).select(*by, "u", (F.col("_top") + F.col("_at")).alias("v"), "squared")


def deepest_points(pixels: DataFrame, by: Sequence[str] = MASK) -> DataFrame:
    """The point of each mask's largest component that is farthest from all outside it (ties: least v, then u): by, u, v, clearance."""
    labelled = checkpointed(labelled_runs(pixels, by))
    largest = largest_components(labelled, by).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("component").alias("_c"))
    same = labelled["component"] == F.col("_c")
    for c in by:
        same = same & labelled[c].eqNullSafe(F.col(f"_{c}"))
    kept = labelled.join(largest, same, "left_semi").select(*by, "v", F.explode(F.sequence("u0", "u1")).alias("u"))
    best = F.max_by(F.struct("u", "v", "squared"), F.struct("squared", (-F.col("v")).alias("v"), (-F.col("u")).alias("u")))
    return distance_transform(kept, by).groupBy(*by).agg(best.alias("_b")).select(*by, "_b.u", "_b.v", F.sqrt("_b.squared").alias("clearance"))
