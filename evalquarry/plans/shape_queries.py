"""Queries of keys, prompts, orders, maps, polygons, points and rows taken as sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import binning as B
from ..functions import geometry as G
from ..functions import planar as P
from ..functions import text as X
from ..operators import audit, metrics, orders, ranking, scene, vectors
from ..sources import io
from .catalog import SQL, define, r6, table
from .response_queries import LINE_SQL
from .value_queries import BOX, ORDERED, PIX, ordered, pixels, polygons


def near_zero(c: Column) -> Column:
    """Six places, and plain 0 for what rounds to it on either side."""
    return G.let(c, lambda v: F.when(F.abs(v) < 5e-7, 0.0).otherwise(r6(v)))


def near_zero_sql(e: str) -> str:
    return f"CASE WHEN abs({e}) < 5e-7 THEN 0.0 ELSE round({e}, 6) END"


@define("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 'C' || o_orderkey % 3 WHEN o_custkey % 2 = 0 THEN 'C2_D4' ELSE 'C2_D8' END AS condition_key, CASE WHEN o_totalprice > 100000 AND o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'INVALID' END AS label, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'OPEN' ELSE 'INVALID' END AS mapped FROM orders")
def keys_and_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of conditions with and without a resolution; labels guarded by their domain, and renamed."""
    k, status = F.col("o_orderkey") % 3, F.col("o_orderstatus")
    resolution = F.when(k == 2, F.when(F.col("o_custkey") % 2 == 0, "D4").otherwise("D8"))
    label = B.guarded_label(status, ["F", "O"], F.col("o_totalprice") > 100000)
    return table(spark, sf, "orders").select("o_orderkey", B.condition_key(F.concat(F.lit("C"), k), resolution).alias("condition_key"), label.alias("label"), B.remap(status, {"F": "DONE", "O": "OPEN"}).alias("mapped"))


@define("SELECT l_orderkey, CASE WHEN coalesce(bool_and(l_returnflag = 'R') FILTER (l_quantity > 25), true) THEN 'all_left' WHEN bool_and(l_returnflag <> 'R') FILTER (l_quantity > 25) THEN 'all_right' ELSE 'mixed' END AS sides FROM lineitem GROUP BY l_orderkey")
def side_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Whether all large lines are on one side; an order without any counts as all left."""
    side = F.when(F.col("l_quantity") > 25, F.when(F.col("l_returnflag") == "R", "left").otherwise("right"))
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(side).alias("s"))
    return li.select("l_orderkey", B.side_class(F.col("s")).alias("sides"))


@define("SELECT p_partkey, 'Item ' || p_name || ' of size ' || p_size || ', again ' || p_size AS prompt, coalesce(printf('%.1f', CAST(nullif(p_size, 10) AS DOUBLE) / 80 * 100) || '%', 'n/a') AS share, CASE WHEN starts_with(p_type, 'STANDARD ') THEN substr(p_type, 10) ELSE p_type END AS short_type FROM part")
def prompt_texts(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    prompt = X.filled("Item {name} of size {size}, again {size}", {"name": F.col("p_name"), "size": size})
    return table(spark, sf, "part").select("p_partkey", prompt.alias("prompt"), X.percent(F.nullif(size, F.lit(10)).cast("double") / 80).alias("share"), X.without_prefix(F.col("p_type"), "STANDARD ").alias("short_type"))


@define("SELECT page_id, sha256(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped, coalesce(list_filter(['Script', 'href', 'password'], lambda t: contains(lower(html), lower(t))), []) AS leaks FROM pages")
def escaped_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as text for HTML, by its hash, and which of some terms they hold."""
    return table(spark, sf, "pages").select("page_id", X.content_key(X.html_escaped(F.col("html"))).alias("escaped"), X.leaks(F.col("html"), ["Script", "href", "password"]).alias("leaks"))


@define(f"SELECT l_orderkey, coalesce(list_position(list_transform(range(1, len(e) + 1), lambda i: e[i] IS DISTINCT FROM p[i]), true) - 1, len(e)) AS shared, list_sort(list_transform(e, lambda x: x % 3)) = list_sort(list_transform(p[2:], lambda x: x % 3)) AS permuted FROM ({ORDERED})")
def order_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """How many leading parts two orders share, and whether one is the other rearranged (the second lacks its first part)."""
    o, third = ordered(spark, sf), lambda a: F.transform(a, lambda x: x % 3)
    return o.select("l_orderkey", X.common_prefix_length(F.col("e"), F.col("p")).cast("bigint").alias("shared"), A.is_permutation(third("e"), third(F.slice("p", F.lit(2), F.size("p")))).alias("permuted"))


@define("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS twice FROM events")
def cached_by_content(spark: SparkSession, sf: str) -> DataFrame:
    """Equal inputs computed once and given to all rows that have them."""
    once = lambda d: d.withColumn("twice", F.get_json_object("props", "$.k").cast("bigint") * 2)
    return io.content_cached(table(spark, sf, "events").select("event_id", "props"), F.col("props"), once).select("event_id", "twice")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's lines as one array of structs (id, part, supp), by id."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), "part", "supp"))).alias("s"))


@define(f"SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_suppkey % 5 > 0 AND l_partkey % 3 = l_suppkey % 3) AS agree, bool_and(l_suppkey % 5 > 0 AND l_partkey % 3 = l_suppkey % 3) AS same FROM ({LINE_SQL}) GROUP BY l_orderkey")
def map_agreements(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of one map to which another gives the same value; the other lacks some of them."""
    entries = lambda s, c: F.map_from_entries(F.transform(s, lambda x: F.struct(x["id"].alias("k"), (x[c] % 3).alias("v"))))
    out = lines(spark, sf).select("l_orderkey", entries(F.col("s"), "part").alias("a"), entries(F.filter("s", lambda x: x["supp"] % 5 > 0), "supp").alias("b"))
    out = out.withColumn("m", A.map_agreement(F.col("a"), F.col("b")))
    return out.select("l_orderkey", F.col("m.total").cast("bigint").alias("total"), F.col("m.agree").cast("bigint").alias("agree"), A.maps_equal(F.col("a"), F.col("b")).alias("same"))


@define(f"WITH d AS ({LINE_SQL}), a AS (SELECT * FROM d WHERE l_linenumber = 2) SELECT d.l_orderkey, count(*) AS total, count(*) FILTER (d.l_suppkey % 7 > 0 AND a.l_suppkey % 7 > 0 AND ((d.l_partkey, d.l_linenumber) < (a.l_partkey, a.l_linenumber)) = ((d.l_suppkey, d.l_linenumber) < (a.l_suppkey, a.l_linenumber))) AS agree FROM d JOIN a ON d.l_orderkey = a.l_orderkey WHERE d.l_linenumber <> 2 GROUP BY d.l_orderkey")
def anchor_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """On which side of an anchor two orders put each object; the second order lacks some objects, at times the anchor."""
    e = A.ids_by(F.col("s"), "part", "id")
    p = A.ids_by(F.filter("s", lambda x: x["supp"] % 7 > 0), "supp", "id")
    out = lines(spark, sf).select("l_orderkey", e.alias("e"), p.alias("p")).filter(F.array_contains("e", 2) & (F.size("e") > 1))
    out = out.withColumn("r", A.relation_agreement(F.col("e"), F.col("p"), F.lit(2)))
    return out.select("l_orderkey", F.col("r.total").cast("bigint").alias("total"), F.col("r.agree").cast("bigint").alias("agree"))


#: Votes on a scene's pairs that needn't be transitive. Subsets of a scene's objects in turn, as bits of their rank: the most votes that an order keeps, how many orders do, and the least of those, from the subsets with one object less.
VOTES = f"""WITH RECURSIVE d AS (SELECT l_orderkey AS k, l_linenumber AS i, l_partkey AS p, CAST(1 << (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) AS INT) AS bit FROM ({LINE_SQL})),
v AS (SELECT a.k, CASE WHEN (a.p + b.p) % 3 > 0 THEN a.bit ELSE b.bit END AS a, CASE WHEN (a.p + b.p) % 3 > 0 THEN b.bit ELSE a.bit END AS b FROM d a JOIN d b ON a.k = b.k AND a.i < b.i),
o AS (SELECT d.k, d.i, d.bit, CAST(coalesce(bit_or(v.b), 0) AS INT) AS beats FROM d LEFT JOIN v ON v.k = d.k AND v.a = d.bit GROUP BY ALL),
r AS (SELECT DISTINCT k, 0 AS s, CAST(0 AS BIGINT) AS kept, CAST(1 AS BIGINT) AS ways, CAST([] AS INTEGER[]) AS first FROM d
  UNION ALL
  SELECT k, s, kept, CAST(sum(ways) AS BIGINT) AS ways, min(first) AS first FROM (
    SELECT *, max(kept) OVER (PARTITION BY k, s) AS most FROM (SELECT r.k, r.s | o.bit AS s, r.kept + bit_count(o.beats & r.s) AS kept, r.ways, list_prepend(o.i, r.first) AS first FROM r JOIN o ON o.k = r.k AND r.s & o.bit = 0))
  WHERE kept = most GROUP BY k, s, kept)
"""


@define(VOTES + "SELECT r.k AS l_orderkey, ways AS n_best, kept, first AS first_best FROM r JOIN (SELECT k, sum(bit) AS every FROM d GROUP BY k) e ON e.k = r.k AND e.every = r.s")
def kemeny_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The orders of all of a scene's objects that agree with most votes on their pairs: how many, and the least of them."""

    def vote(p: Column) -> Column:
        first = (p["a"]["part"] + p["b"]["part"]) % 3 > 0
        a, b = p["a"]["id"], p["b"]["id"]
        return F.struct(F.when(first, a).otherwise(b).alias("a"), F.when(first, b).otherwise(a).alias("b"))

    out = lines(spark, sf).select("l_orderkey", F.transform("s", lambda x: x["id"]).alias("ids"), F.transform(A.pairs_in_order(F.col("s")), vote).alias("votes"))
    out = orders.kemeny(out, F.col("ids"), F.col("votes"))
    return out.select("l_orderkey", "best.n_best", F.col("best.kept").cast("bigint").alias("kept"), F.col("best.first").alias("first_best"))


FLAGS = "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 3 <> 1 AS cq, l_partkey % 3 <> 0 AS tq, CASE WHEN l_suppkey % 4 > 0 THEN l_quantity > 25 END AS cf, CASE WHEN l_suppkey % 5 > 1 THEN l_discount > 0.05 END AS tf, l_tax > 0.04 AS m FROM lineitem"


@define(f"SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN cq AND NOT tq THEN tf IS NULL AND cf IS NOT NULL AND m = cf WHEN tq AND NOT cq THEN cf IS NULL AND tf IS NOT NULL AND m = tf ELSE cf IS NOT NULL AND tf IS NOT NULL AND m = (cf AND tf) END, false) AS obeys FROM ({FLAGS})")
def query_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Whether flags fit a query by colour, by type or by both."""
    part, supp = F.col("l_partkey") % 3, F.col("l_suppkey")
    colour, kind = F.when(supp % 4 > 0, F.col("l_quantity") > 25), F.when(supp % 5 > 1, F.col("l_discount") > 0.05)
    obeys = A.query_rule(part != 1, part != 0, colour, kind, F.col("l_tax") > 0.04)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", obeys.alias("obeys"))


#: A square for each line, in centimetres, turned about its centre (x, y); h is half a side.
SQUARE = "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 40 - 20 AS DOUBLE) AS x, CAST(l_suppkey % 30 - 15 AS DOUBLE) AS y, (2 + l_quantity / 10) / 2 AS h, radians(l_partkey % 360) AS t FROM lineitem"


@define(
    f"WITH s AS ({SQUARE}) SELECT l_orderkey, l_linenumber, l_partkey, {near_zero_sql('x')} AS cx, {near_zero_sql('y')} AS cy, {near_zero_sql('4 * h * h')} AS area, {near_zero_sql('cos(t)')} AS ux, {near_zero_sql('sin(t)')} AS uy, {near_zero_sql('x + 3 - h * cos(t) + h * sin(t)')} AS corner_x, {near_zero_sql('y - 1 - h * sin(t) - h * cos(t)')} AS corner_y, "
    f"4 AS hull_size, abs(x) + h * (abs(cos(t)) + abs(sin(t))) <= 20.0000001 AND abs(y) + h * (abs(cos(t)) + abs(sin(t))) <= 20.0000001 AS inside, {near_zero_sql('degrees(atan2(y, x)) - 360 * floor(degrees(atan2(y, x)) / 360)')} AS bearing FROM s"
)
def polygon_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Centre, area, hull, turn, shift, bounds and bearing of a square that is turned about its centre."""
    x, y, h = (F.col("l_partkey") % 40 - 20).cast("double"), (F.col("l_suppkey") % 30 - 15).cast("double"), (2 + F.col("l_quantity") / 10) / 2
    degrees = F.col("l_partkey") % 360
    square = F.array(G.point(x - h, y - h), G.point(x + h, y - h), G.point(x + h, y + h), G.point(x - h, y + h))

    m, d = F.col("m"), G.direction_vector(degrees)
    inside = (m["xmin"] >= -20.0 - G.TOLERANCE) & (m["xmax"] <= 20.0 + G.TOLERANCE) & (m["ymin"] >= -20.0 - G.TOLERANCE) & (m["ymax"] <= 20.0 + G.TOLERANCE)
    numbers = {"cx": m["cx"], "cy": m["cy"], "area": m["area"], "ux": d["x"], "uy": d["y"], "corner_x": m["x"] + 3.0, "corner_y": m["y"] - 1.0, "bearing": G.bearing(x, y)}
    rounded = (F.when(F.abs(v) < 5e-7, 0.0).otherwise(r6(v)).alias(n) for n, v in numbers.items())
    out = table(spark, sf, "lineitem").withColumn("m", P.turned_measures(square, degrees))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", m["hull_size"].cast("int").alias("hull_size"), inside.alias("inside"), *rounded)


#: Corners of a rectangle seen from the origin; widest is the largest gap between neighbouring angles.
ARC = (
    "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 40 - 20 + 0.37 AS x, l_suppkey % 30 - 15 + 0.21 AS y, 1 + l_quantity / 9.7 AS w FROM lineitem), b AS (SELECT * EXCLUDE (x, y, w), list_sort(list_transform([[x, y], [x + w, y], [x + w, y + w], [x, y + w]], lambda c: degrees(atan2(c[2], c[1])) - 360 * floor(degrees(atan2(c[2], c[1])) / 360))) AS a FROM r), "
    "g AS (SELECT *, list_max(list_transform(range(1, 5), lambda i: {'gap': CASE WHEN i < 4 THEN a[i + 1] - a[i] ELSE a[1] + 360 - a[4] END, 'i': i})).i AS i FROM b), s AS (SELECT * EXCLUDE (a, i), round(a[i], 1) AS last, round(a[i % 4 + 1], 1) AS first, a[i % 4 + 1] <= a[i] AS whole FROM g) "
)


@define(ARC + "SELECT l_orderkey, l_linenumber, l_partkey, first AS arc_start, last AS arc_end, CASE WHEN whole THEN 1 ELSE 2 END AS arcs FROM s")
def occupied_arcs(spark: SparkSession, sf: str) -> DataFrame:
    """The arc that a rectangle covers around the origin, in two where it goes past 0 degrees."""
    x, y, w = F.col("l_partkey") % 40 - 20 + 0.37, F.col("l_suppkey") % 30 - 15 + 0.21, 1 + F.col("l_quantity") / 9.7
    rectangle = F.array(G.point(x, y), G.point(x + w, y), G.point(x + w, y + w), G.point(x, y + w))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", G.occupied_arc(G.point(F.lit(0.0), F.lit(0.0)), rectangle).alias("a"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("a")[0]["start"].alias("arc_start"), F.element_at("a", -1)["end"].alias("arc_end"), F.size("a").alias("arcs"))


@define(
    "WITH s AS (SELECT s_suppkey, s_suppkey * 37 % 360 AS a, s_suppkey * 11 % 90 + 5 AS w FROM supplier), c AS (SELECT s_suppkey, a, least(a + w, 360) AS b FROM s), d AS (SELECT unnest(['RIGHT', 'BACK', 'LEFT', 'FRONT']) AS name, unnest([0, 90, 180, 270]) AS t) "
    "SELECT s_suppkey, list(name ORDER BY t) AS directions FROM c JOIN d ON (t BETWEEN a - 45 AND b + 45) OR (a - 45 < 0 AND t >= 315 + a) OR (b + 45 > 360 AND t <= b - 315) GROUP BY s_suppkey"
)
def occupied_sectors(spark: SparkSession, sf: str) -> DataFrame:
    """Compass directions whose sector an arc touches, across 0 degrees too."""
    k = F.col("s_suppkey")
    start = (k * 37 % 360).cast("double")
    arc = F.array(F.struct(start.alias("start"), F.least(start + k * 11 % 90 + 5, F.lit(360.0)).alias("end")))
    return table(spark, sf, "supplier").select("s_suppkey", G.occupied_directions(arc, G.D4).alias("directions"))


@define("WITH b AS (SELECT scene_id, object_id, x * 100 AS x, y * 100 AS y, w * 50 AS h FROM (SELECT scene_id, object_id, min(x) AS x, min(y) AS y, min(w) AS w FROM (" + BOX + ") GROUP BY ALL)) SELECT a.scene_id, count(*) AS pairs, count(*) FILTER (abs(a.x - b.x) <= a.h + b.h + 1e-6 AND abs(a.y - b.y) <= a.h + b.h + 1e-6) AS meeting FROM b a JOIN b ON a.scene_id = b.scene_id AND a.object_id < b.object_id GROUP BY a.scene_id")
def meeting_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs of a scene's polygons touch or overlap."""
    p = polygons(spark, sf)
    other = p.select("scene_id", F.col("object_id").alias("other"), F.col("polygon").alias("q"))
    pairs = p.join(other, "scene_id").filter("object_id < other")
    return pairs.groupBy("scene_id").agg(F.count("*").alias("pairs"), F.count_if(G.intersects(F.col("polygon"), F.col("q"), 1e-6)).alias("meeting"))


@define(f"WITH p AS (SELECT DISTINCT scene_id, object_id, u, v FROM ({PIX})) SELECT scene_id, object_id, count(*) AS points, round(avg(CASE WHEN u BETWEEN object_id - 0.5 AND 30.5 AND v BETWEEN 4.5 AND 25.5 THEN 1 ELSE 0 END), 6) AS inside_share, round(avg(CASE WHEN u % 9 > 0 THEN 1 ELSE 0 END), 6) AS valid_share FROM p GROUP BY ALL")
def points_in_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each object's points inside its widened box, and of those with a depth."""
    p = pixels(spark, sf).select("scene_id", "object_id", F.col("u").alias("x"), F.col("v").alias("y"), (F.col("u") % 9).alias("depth"))
    b = p.select("scene_id", "object_id").distinct().withColumn("box", G.rect(F.col("object_id"), F.lit(5), F.lit(30), F.lit(25)))
    return scene.point_coverage(p, b, 0.5).withColumns({c: r6(F.col(c)) for c in ("inside_share", "valid_share")})


@define(f"WITH p AS (SELECT DISTINCT scene_id, u, v FROM ({PIX})) SELECT scene_id, count(*) AS pixels, count(*) FILTER (greatest(abs(u * 3 - v * 2), abs(v - u), abs(u - 20)) > 25) AS changed FROM p GROUP BY scene_id")
def changed_pixels(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf).select("scene_id", "u", "v").distinct()
    one = p.select("*", (F.col("u") * 3).alias("r"), F.col("v").alias("g"), F.col("u").alias("b"))
    two = p.select("*", (F.col("v") * 2).alias("r"), F.col("u").alias("g"), F.lit(20).alias("b"))
    return scene.changed_pixels(one, two)


CLAIMS = {"badges": "object_id < 3", "masks": "object_id > 0 AND scene_id % 7 > 0"}
COVER = f"WITH o AS (SELECT DISTINCT scene_id, object_id FROM ({PIX}) WHERE object_id < 4), a AS (SELECT DISTINCT scene_id, object_id FROM ({PIX}))"


@define(f"{COVER} " + " UNION ALL ".join(f"SELECT scene_id, object_id, '{n}' AS claim, CASE WHEN c.k IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT *, 1 AS k FROM o) o FULL JOIN (SELECT *, 1 AS k FROM a WHERE {c}) c USING (scene_id, object_id) WHERE o.k IS NULL OR c.k IS NULL" for n, c in CLAIMS.items()))
def object_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Objects that badges or masks lack, or have beyond those of the scene."""
    p = pixels(spark, sf)
    return scene.coverage_audit(p.filter("object_id < 4").select("scene_id", "object_id").distinct(), *((n, p.filter(c)) for n, c in CLAIMS.items()))


#: Points of a role in the order of their hash; where there are fewer than 32, they repeat in that order.
SQL["point_sample"] = (
    f"WITH p AS (SELECT DISTINCT scene_id, object_id, u * 100 + v AS point_id FROM ({PIX})), h AS (SELECT *, row_number() OVER (PARTITION BY scene_id, object_id ORDER BY sha256(concat_ws(chr(0), 'points', scene_id, object_id, point_id))) AS r, count(*) OVER (PARTITION BY scene_id, object_id) AS n FROM p) "
    "SELECT scene_id, object_id, point_id, unnest(range(r, 33, least(n, 32))) AS slot FROM h WHERE r <= 32"
)

#: The first object of a scene is the target, the second the blocker, the others obstacles. c is the time when the moving blocker first meets one.
EDGES = "SELECT scene_id, object_id, {'a': x - w / 2, 'b': y - w / 2, 'c': x + w / 2, 'd': y + w / 2} AS o FROM (" + BOX + ")"
SLAB = "CASE WHEN abs(v{k}) < 1e-12 THEN {still} ELSE {pick}((o.{lo} - 0.002 - r.{hi}) / v{k}, (o.{hi} + 0.002 - r.{lo}) / v{k}) END"
ROOM = "CASE WHEN v{k} > 0 THEN (0.298 - r.{hi}) / v{k} WHEN v{k} < 0 THEN (-0.298 - r.{lo}) / v{k} END"
PAST = "CASE WHEN v{k} > 0 THEN (s.{hi} - r.{lo}) / v{k} WHEN v{k} < 0 THEN (s.{lo} - r.{hi}) / v{k} END"
AXES = [{"k": "x", "lo": "a", "hi": "c"}, {"k": "y", "lo": "b", "hi": "d"}]
ENTRY, LEAVE = (f"{'greatest' if pick == 'least' else 'least'}({', '.join(SLAB.format(pick=pick, still=still, **x) for x in AXES)})" for pick, still in (("least", "'-inf'::DOUBLE"), ("greatest", "'inf'::DOUBLE")))
MISS = " OR ".join("(abs(v{k}) < 1e-12 AND (r.{hi} <= o.{lo} - 0.002 OR r.{lo} >= o.{hi} + 0.002))".format(**x) for x in AXES)
COMMON = "greatest(0, least(t.c, s.c) - greatest(t.a, s.a)) * greatest(0, least(t.d, s.d) - greatest(t.b, s.b))"

SQL["translation_candidates"] = (
    f"WITH b AS ({EDGES}), p AS (SELECT scene_id, min(o) FILTER (object_id = 1) AS goal, min(o) FILTER (object_id = 2) AS r FROM b GROUP BY scene_id), "
    "q AS (SELECT scene_id, goal, r, {'a': goal.a - 0.01, 'b': -0.3, 'c': goal.c + 0.01, 'd': goal.b} AS s FROM p WHERE goal IS NOT NULL AND r IS NOT NULL), "
    f"w AS (SELECT * FROM (SELECT *, r AS t FROM q) WHERE {COMMON} > 1e-8), shut AS (SELECT DISTINCT scene_id FROM (SELECT w.scene_id, w.s, b.o AS t FROM w JOIN b ON b.scene_id = w.scene_id AND b.object_id > 2) WHERE {COMMON} > 1e-8), "
    "z AS (SELECT unnest(['" + "', '".join(G.D8) + f"']) AS direction, unnest({list(G.D8.values())}) AS t), v AS (SELECT direction, CASE WHEN abs(cos(radians(t))) < 1e-12 THEN 0 ELSE cos(radians(t)) END AS vx, CASE WHEN abs(sin(radians(t))) < 1e-12 THEN 0 ELSE sin(radians(t)) END AS vy FROM z), "
    "m AS (SELECT w.scene_id, w.r, w.s, v.* FROM w, v WHERE w.scene_id NOT IN (SELECT scene_id FROM shut)), things AS (SELECT scene_id, o FROM b WHERE object_id > 2 UNION ALL SELECT scene_id, goal FROM q), "
    f"c AS (SELECT m.scene_id, m.direction, min(CASE WHEN NOT ({MISS}) AND {LEAVE} > greatest({ENTRY}, 0) THEN greatest({ENTRY}, 0) END) AS c FROM m JOIN things ON things.scene_id = m.scene_id GROUP BY ALL), "
    f"l AS (SELECT m.*, greatest(0, least(0.45, {', '.join(ROOM.format(**x) for x in AXES)}, c.c)) AS lim, greatest(ceil(least({', '.join(PAST.format(**x) for x in AXES)}) / 0.001 - 1e-9), 1) AS n FROM m JOIN c USING (scene_id, direction)), "
    'f AS (SELECT scene_id, direction, n * 0.001 AS distance, round(lim, 6) AS "limit" FROM l WHERE n <= floor((lim - 1e-8) / 0.001)) SELECT scene_id, direction, round(distance, 6) AS distance, "limit", row_number() OVER (PARTITION BY scene_id ORDER BY distance, direction) AS rank FROM f'
)


@define("SELECT vec_id, list_concat(l[33:64], l[1:32]) AS mirrored, (list_position(l, list_max(l)) - 1) // 8 AS direction, (list_position(l, list_max(l)) - 1) % 8 AS distance, round(l[1] + least(0.01, abs(l[2]) / 4), 6) AS low, round(l[1] + abs(l[2]) - least(0.01, abs(l[2]) / 4), 6) AS high FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS l FROM embeddings)")
def action_decode(spark: SparkSession, sf: str) -> DataFrame:
    """A joint action's direction and distance, the mirrored scene's vector, and narrowed safe bounds."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("l"))
    out = e.withColumns({"j": vectors.joint_decode(F.col("l"), 8), "b": vectors.safe_bounds(F.col("l")[0], F.col("l")[0] + F.abs(F.col("l")[1]), 0.01)})
    return out.select("vec_id", A.mirrored_mask(F.col("l")).alias("mirrored"), F.col("j.direction").cast("bigint").alias("direction"), F.col("j.distance").cast("bigint").alias("distance"), r6(F.col("b.low")).alias("low"), r6(F.col("b.high")).alias("high"))


@define("SELECT o_custkey, list(o_orderkey ORDER BY coalesce(list_position(['2-HIGH', '1-URGENT', '5-LOW'], o_orderpriority), 4), o_orderkey) AS in_order FROM orders GROUP BY o_custkey")
def in_domain_order(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in the order of a stated list of labels; labels that aren't listed come last."""
    rank = ranking.domain_order(F.col("o_orderpriority"), ["2-HIGH", "1-URGENT", "5-LOW"]).cast("int")
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "o_orderkey"))).alias("s"))
    return o.select("o_custkey", F.col("s.o_orderkey").alias("in_order"))


SPECS = {"urgent": "o_orderpriority = '1-URGENT'", "open": "o_orderstatus = 'O'", "any": "o_totalprice > 0"}
CHOSEN = [f"c{i} AS (SELECT '{name}' AS spec, {i} AS spec_order, * FROM orders WHERE {rule}{''.join(f' AND o_orderkey NOT IN (SELECT o_orderkey FROM c{j})' for j in range(i))} ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)" for i, (name, rule) in enumerate(SPECS.items())]


@define(f"WITH {', '.join(CHOSEN)} " + " UNION ALL ".join(f"SELECT spec, spec_order, o_orderkey, o_totalprice FROM c{i}" for i in range(len(SPECS))))
def representatives(spark: SparkSession, sf: str) -> DataFrame:
    """The dearest order that meets each rule in turn and isn't taken yet."""
    specs = [(name, F.expr(rule)) for name, rule in SPECS.items()]
    return ranking.representatives(table(spark, sf, "orders"), specs, "o_orderkey", [F.desc("o_totalprice")]).select("spec", "spec_order", "o_orderkey", "o_totalprice")


@define("SELECT key, balance, segment FROM (SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_suppkey AS key, s_acctbal AS balance FROM supplier)")
def unequal_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of two tables of which one lacks a column."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return io.union_all(c, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")))


ROWS = ("SELECT l_orderkey % 50 AS k, l_linenumber AS n FROM lineitem", "SELECT l_partkey % 50 AS k, l_linenumber AS n FROM lineitem")


@define(" UNION ALL ".join(f"SELECT *, '{side}' AS side FROM (({a}) EXCEPT ALL ({b}))" for side, a, b in (("left", *ROWS), ("right", *ROWS[::-1]))))
def same_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that either of two tables has more often than the other."""
    li = table(spark, sf, "lineitem")
    return audit.same_rows(*(li.select((F.col(c) % 50).alias("k"), F.col("l_linenumber").alias("n")) for c in ("l_orderkey", "l_partkey")))
