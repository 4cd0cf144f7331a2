"""Queries of the text, array, vector, geometry and scene operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import binning as B
from ..functions import geometry as G
from ..functions import text as X
from ..operators import masks, metrics, scene, vectors
from ..operators.stable import spread
from .catalog import define, r6, table

ORDERED = "SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS e, list(l_partkey ORDER BY l_extendedprice, l_linenumber, l_partkey) AS p FROM lineitem GROUP BY l_orderkey"


def ordered(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's parts by line number and by price."""
    li = table(spark, sf, "lineitem")
    rows = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice")).alias("s"))
    by = lambda *names: F.transform(F.array_sort(F.transform("s", lambda x: F.struct(*(x[n].alias(n) for n in names)))), lambda x: x["l_partkey"])
    return rows.select("l_orderkey", by("l_linenumber", "l_partkey", "l_extendedprice").alias("e"), by("l_extendedprice", "l_linenumber", "l_partkey").alias("p"))


@define("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS normal FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.normalized(F.col("text")).alias("normal"))


@define("SELECT doc_id, contains(t, ' the and ') OR contains(t, ' of that ') AS matches FROM (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents)")
def phrase_match(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.phrase_matches(F.col("text"), F.array(F.lit("The and"), F.lit("of that"))).alias("matches"))


@define("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS error FROM events")
def json_props_strict_parse(spark: SparkSession, sf: str) -> DataFrame:
    parsed = X.strict_json(F.col("props"), "k bigint", ["k"])
    return table(spark, sf, "events").select("event_id", parsed["value"]["k"].alias("k"), parsed["error"].alias("error"))


@define(
    "WITH r AS (SELECT CASE event_id % 5 WHEN 0 THEN substr(props, 1, 3) WHEN 1 THEN replace(props, 'k', 'j') WHEN 2 THEN '[1]' WHEN 3 THEN '{\"k\": \"x\"}' ELSE props END AS raw FROM events) "
    "SELECT CASE WHEN NOT json_valid(raw) THEN 'not_json' WHEN json_type(raw) <> 'OBJECT' THEN 'not_object' WHEN json_keys(raw) <> ['k'] THEN 'keys' WHEN try_cast(json_extract_string(raw, '$.k') AS BIGINT) IS NULL THEN 'type' ELSE 'fine' END AS error, count(*) AS n FROM r GROUP BY 1"
)
def json_error_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id") % 5
    raw = F.when(i == 0, F.substring("props", 1, 3)).when(i == 1, F.replace("props", F.lit("k"), F.lit("j"))).when(i == 2, F.lit("[1]")).when(i == 3, F.lit('{"k": "x"}')).otherwise(F.col("props"))
    error = X.strict_json(F.col("raw"), "k bigint", ["k"])["error"]
    return table(spark, sf, "events").select(raw.alias("raw")).select(F.coalesce(error, F.lit("fine")).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


@define("SELECT p_partkey, CASE WHEN p_size <= 25 THEN [p_name, p_type] END AS first_record, CASE WHEN p_size > 25 THEN 'line 2: expected 2 fields' END AS error FROM part")
def pipe_record_parse(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws("\n", F.concat_ws(" | ", "p_name", "p_type"), F.lit(""), F.when(F.col("p_size") > 25, F.lit("odd")).otherwise(F.lit("a|b")))
    out = X.pipe_records(text, 2)
    return table(spark, sf, "part").select("p_partkey", out["records"][0].alias("first_record"), out["error"].alias("error"))


@define("SELECT o_orderkey, [o_orderkey, o_custkey] AS ids FROM orders")
def int_list_parse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", X.int_list(F.concat_ws(", ", "o_orderkey", "o_custkey")).alias("ids"))


@define("SELECT p_partkey, '{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}' AS canonical, sha256('{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}') AS key FROM part")
def canonical_key(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    return p.select("p_partkey", X.canonical_json(["size", "brand"]).alias("canonical")).withColumn("key", X.content_key(F.col("canonical")))


@define("SELECT c_custkey, CAST(CAST(('0x' || substr(sha256(c_name), 1, 16)) AS UBIGINT) AS DECIMAL(20, 0)) AS seed FROM customer")
def sha_seed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", X.seed64(F.col("c_name")).alias("seed"))


@define("SELECT l_orderkey, len(list_intersect(a, b)) AS tp, len(b) - len(list_intersect(a, b)) AS fp, len(a) - len(list_intersect(a, b)) AS fn, len(a) = len(b) AND len(a) = len(list_intersect(a, b)) AS exact FROM (SELECT l_orderkey, list_distinct(list(l_suppkey % 10)) AS a, list_distinct(list(l_partkey % 10)) AS b FROM lineitem GROUP BY l_orderkey)")
def set_scores(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey") % 10).alias("a"), F.collect_list(F.col("l_partkey") % 10).alias("b"))
    return li.select("l_orderkey", A.set_scores(F.col("a"), F.col("b")).alias("s")).select("l_orderkey", *(F.col(f"s.{c}").cast("bigint").alias(c) for c in ("tp", "fp", "fn")), "s.exact")


@define("WITH v AS (SELECT l_orderkey, x, sum(a) AS a, sum(b) AS b FROM (SELECT l_orderkey, l_suppkey % 4 AS x, 1 AS a, 0 AS b FROM lineitem UNION ALL SELECT l_orderkey, l_partkey % 4, 0, 1 FROM lineitem) GROUP BY ALL) SELECT l_orderkey, CAST(sum(least(a, b)) AS BIGINT) AS tp, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS fp, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS fn FROM v GROUP BY l_orderkey")
def multiset_scores(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey") % 4).alias("a"), F.collect_list(F.col("l_partkey") % 4).alias("b"))
    return li.select("l_orderkey", A.multiset_scores(F.col("a"), F.col("b")).alias("s")).select("l_orderkey", *(F.col(f"s.{c}").cast("bigint").alias(c) for c in ("tp", "fp", "fn")))


@define(f"WITH o AS (SELECT l_orderkey, list_distinct(e) AS d, e, p FROM ({ORDERED})), x AS (SELECT l_orderkey, e, p, unnest(range(1, len(e) + 1)) AS i FROM o), y AS (SELECT l_orderkey, e, p, i, unnest(range(i + 1, len(e) + 1)) AS j FROM x) SELECT l_orderkey, count(*) AS total, count(*) FILTER (list_position(p, e[i]) < list_position(p, e[j])) AS agree FROM y GROUP BY l_orderkey")
def pairwise_order_agreement(spark: SparkSession, sf: str) -> DataFrame:
    o = ordered(spark, sf).withColumn("s", A.order_agreement(F.col("e"), F.col("p"))).filter(F.size("e") > 1)
    return o.select("l_orderkey", F.col("s.total").cast("bigint").alias("total"), F.col("s.agree").cast("bigint").alias("agree"))


@define(f"SELECT l_orderkey, e[1:len(e) // 2] AS front, e[len(e) // 2 + 2:] AS behind FROM ({ORDERED}) WHERE list_position(e, e[len(e) // 2 + 1]) = len(e) // 2 + 1")
def partition_from_order(spark: SparkSession, sf: str) -> DataFrame:
    o = ordered(spark, sf).withColumn("m", F.element_at("e", (F.floor(F.size("e") / 2) + 1).cast("int")))
    o = o.filter(F.array_position("e", F.col("m")) == F.floor(F.size("e") / 2) + 1)
    return o.select("l_orderkey", A.relations(F.col("e"), F.col("m")).alias("r")).select("l_orderkey", "r.front", "r.behind")


@define(f"SELECT l_orderkey, e = list_sort(list_distinct(e)) AS ascending, len(list_filter(list_zip(list_sort(e)[2:], list_sort(e)[:-2]), lambda z: z[1] - z[2] <= 1)) = 0 AS sparse FROM ({ORDERED})")
def array_checks(spark: SparkSession, sf: str) -> DataFrame:
    return ordered(spark, sf).select("l_orderkey", A.sorted_unique(F.col("e")).alias("ascending"), A.sparse_ids(F.col("e")).alias("sparse"))


@define("SELECT p_partkey, CASE WHEN p_size - 10 <= 0 THEN 'NONE' WHEN p_size - 10 <= 5 THEN 'SHORT' WHEN p_size - 10 <= 10 THEN 'MEDIUM' ELSE 'LONG' END AS level, CASE WHEN p_size >= 2 AND p_size < 5 THEN 'short' WHEN p_size >= 5 AND p_size < 9 THEN 'medium' WHEN p_size >= 9 AND p_size < 25.1 THEN 'long' END AS bin FROM part")
def step_bins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", B.translation_level(F.col("p_size") - 10).alias("level"), B.distance_bin(F.col("p_size")).alias("bin"))


PREFIXES = {"ECONOMY": "cheap", "STANDARD": "plain", "PROMO": "offer", "SMALL": "small", "MEDIUM": "middle", "LARGE": "large"}


@define("SELECT p_partkey, CASE " + " ".join(f"WHEN starts_with(p_type, '{a}') THEN '{b}'" for a, b in PREFIXES.items()) + " END AS family FROM part")
def prefix_family(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", B.prefix_class(F.col("p_type"), PREFIXES, strict=False).alias("family"))


@define("SELECT o_orderstatus, cell, count(*) AS n FROM (SELECT o_orderstatus, CASE WHEN o_totalprice > 200000 AND o_orderpriority = '1-URGENT' THEN 'both' WHEN o_totalprice > 200000 THEN 'a_only' WHEN o_orderpriority = '1-URGENT' THEN 'b_only' ELSE 'neither' END AS cell FROM orders) GROUP BY ALL")
def joint_category(spark: SparkSession, sf: str) -> DataFrame:
    both = B.joint(F.col("o_totalprice") > 200000, F.col("o_orderpriority") == "1-URGENT")
    return table(spark, sf, "orders").select("o_orderstatus", both.alias("cell")).groupBy("o_orderstatus", "cell").agg(F.count("*").alias("n"))


@define("SELECT value, count(*) AS n FROM (SELECT unnest(['late', 'cheap', 'free']) AS value, unnest([o_orderpriority = '5-LOW', o_totalprice < 100000, o_totalprice <= 0]) AS broken FROM orders) WHERE broken GROUP BY value")
def constraint_violations(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"late": F.col("o_orderpriority") != "5-LOW", "cheap": F.col("o_totalprice") >= 100000, "free": F.col("o_totalprice") > 0}
    return metrics.array_frequencies(table(spark, sf, "orders"), B.violations(rules))


@define("SELECT r_name, res FROM (SELECT r_name, unnest(CASE WHEN r_regionkey % 2 = 0 THEN ['D4', 'D8'] ELSE [r_name] END) AS res FROM region)")
def null_expansion(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").withColumn("res", F.when(F.col("r_regionkey") % 2 != 0, F.col("r_name")))
    return r.select("r_name", F.explode(A.expand_null(F.col("res"), ["D4", "D8"])).alias("res"))


@define("SELECT n_regionkey, min_by(n_name, (n_nationkey * 7 % 10, n_name)) AS nearest, list(n_name ORDER BY n_nationkey * 7 % 10, n_name) AS ids FROM nation GROUP BY n_regionkey")
def ordered_projection(spark: SparkSession, sf: str) -> DataFrame:
    items = F.collect_list(F.struct((F.col("n_nationkey") * 7 % 10).alias("k"), "n_name"))
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(items.alias("i"))
    return n.select("n_regionkey", A.nearest_item(F.col("i"), "k", "n_name").alias("nearest"), A.ids_by(F.col("i"), "k", "n_name").alias("ids"))


SMALL = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
PAIRS = f"SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) AS c FROM ({SMALL}) a JOIN ({SMALL}) b ON a.vec_id < b.vec_id"


#: The stated set of asked vectors, with every other vector.
ASKED = "vec_id % 50 = 0"


def asked_sql(v: str) -> str:
    """vec_id_i, vec_id_j and c, the cosine of the asked vectors with every other one of a table of vectors."""
    return f"SELECT a.vec_id AS vec_id_i, b.vec_id AS vec_id_j, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) AS c FROM ({v}) a JOIN ({v}) b ON a.vec_id <> b.vec_id WHERE a.{ASKED}"


@define(f"SELECT vec_id_i, vec_id_j, round(c, 6) AS cosine FROM ({asked_sql(SMALL)})")
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every 50th vector against all others: a whole similarity matrix is quadratic, so its rows are a stated set."""
    return vectors.asked_cosines(table(spark, sf, "embeddings"), "vec_id", "embedding", F.expr(ASKED)).withColumn("cosine", r6(F.col("cosine")))


@define(f"SELECT count(*) FILTER (li = lj) AS within_n, count(*) FILTER (li <> lj) AS between_n, round(avg(c) FILTER (li = lj), 6) AS within, round(avg(c) FILTER (li <> lj), 6) AS between, round(stddev_pop(c) FILTER (li = lj), 6) AS within_sd, round(stddev_pop(c) FILTER (li <> lj), 6) AS between_sd, round(avg(c) FILTER (li = lj) - avg(c) FILTER (li <> lj), 6) AS gap FROM ({PAIRS})")
def group_pair_gap(spark: SparkSession, sf: str) -> DataFrame:
    out = vectors.all_pairs_gap(table(spark, sf, "embeddings"), "embedding", "label", 64)
    return out.withColumns({c: r6(F.col(c)) for c in ("within", "between", "within_sd", "between_sd", "gap")})


@define(f"WITH p AS (SELECT i AS k, li AS l, j AS o, lj AS ol, c FROM ({PAIRS}) UNION ALL SELECT j, lj, i, li, c FROM ({PAIRS})), t AS (SELECT k, l, arg_max(ol, (c, -o)) AS nearest FROM p GROUP BY k, l) SELECT l AS label, count(*) AS n, count(*) FILTER (nearest = l) AS agree FROM t GROUP BY l")
def nn1_label_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.nearest_agreement(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


CENTRED = "SELECT vec_id, list(x - m ORDER BY d) AS v FROM (SELECT vec_id, d, x, avg(x) OVER (PARTITION BY d) AS m FROM (SELECT vec_id, unnest(range(1, 65)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)) GROUP BY vec_id"


@define(f"WITH c AS ({CENTRED}) SELECT vec_id_i, vec_id_j, round(c, 6) AS cosine FROM ({asked_sql('SELECT * FROM c')})")
def centered_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Every 50th vector against all others, all less the mean of all."""
    e = table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return vectors.asked_cosines(vectors.centred(e, "embedding", 64), "vec_id", "embedding", F.expr(ASKED)).withColumn("cosine", r6(F.col("cosine")))


@define(None)
def principal_axes(spark: SparkSession, sf: str) -> DataFrame:
    """Unit vectors along the first two principal axes of all; eigenvectors are beyond SQL, a test has numpy's."""
    e = table(spark, sf, "embeddings").select("vec_id", vectors.unit(F.col("embedding")).alias("u"))
    out = vectors.projected(e, "u", 64)
    return out.select("vec_id", r6(F.col("pca")[0]).alias("x"), r6(F.col("pca")[1]).alias("y"))


LOGITS = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS l FROM embeddings"


@define(f"SELECT vec_id, list_position(l, list_max(l)) - 1 AS choice, round(exp(list_max(l)) / list_sum(list_transform(l, lambda x: exp(x))), 6) AS p, round(ln(list_sum(list_transform(l, lambda x: exp(x)))), 6) AS total, round(ln(list_sum(list_transform(l, lambda x: exp(x)))) - l[1], 6) AS ce FROM ({LOGITS})")
def softmax_decode(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("l"))
    return e.select("vec_id", vectors.argmax(F.col("l")).cast("bigint").alias("choice"), r6(F.array_max(vectors.softmax(F.col("l")))).alias("p"), r6(vectors.logsumexp(F.col("l"))).alias("total"), r6(vectors.cross_entropy(F.col("l"), F.lit(0))).alias("ce"))


@define("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS l FROM embeddings), s AS (SELECT vec_id, l, list_transform(range(0, 8), lambda d: ln(list_sum(list_transform(l[d * 8 + 1:d * 8 + 8], lambda x: exp(x))))) AS m FROM e), d AS (SELECT *, list_position(m, list_max(m)) - 1 AS direction FROM s) SELECT vec_id, direction, list_position(l[direction * 8 + 1:direction * 8 + 8], list_max(l[direction * 8 + 1:direction * 8 + 8])) - 1 AS distance, round(list_max(m), 6) AS marginal FROM d")
def logsumexp_marginal(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("l"))
    e = e.select("vec_id", vectors.direction_first(F.col("l"), 8, 8).alias("d"))
    return e.select("vec_id", F.col("d.direction").cast("bigint").alias("direction"), F.col("d.distance").cast("bigint").alias("distance"), r6(F.col("d.marginal")).alias("marginal"))


@define("SELECT s_suppkey, round(abs((a - b + 180) - 360 * floor((a - b + 180) / 360) - 180), 6) AS apart, CASE CAST(floor((b + 45) / 90) AS INT) % 4 WHEN 0 THEN 'RIGHT' WHEN 1 THEN 'BACK' WHEN 2 THEN 'LEFT' ELSE 'FRONT' END AS nearest FROM (SELECT s_suppkey, s_suppkey * 37 % 360 + 0.5 AS a, s_acctbal - 360 * floor(s_acctbal / 360) AS b FROM supplier)")
def angular_bins(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 360 + 0.5).alias("a"), F.pmod("s_acctbal", F.lit(360.0)).alias("b"))
    return s.select("s_suppkey", r6(G.angular_distance(F.col("a"), F.col("b"))).alias("apart"), G.nearest_direction(F.col("b"), G.D4, ahead=True).alias("nearest"))


BOX = "SELECT l_orderkey AS scene_id, l_linenumber AS object_id, min(l_partkey % 40 / 100.0 - 0.2) AS x, min(l_suppkey % 30 / 100.0 - 0.15) AS y, min(0.02 + l_quantity / 1000) AS w FROM lineitem GROUP BY ALL"


#: Lines of a partition: what is done scene by scene then needs no other shuffle, and no more memory on larger tables.
LINES = 250_000


def by_order(spark: SparkSession, sf: str) -> DataFrame:
    """What scenes are made of, dealt by order."""
    return spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_orderkey", rows=LINES)


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """A made-up scene of rectangles for each order, one for each line number: of repeated ones the least x, y and width."""
    li = by_order(spark, sf).groupBy(F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").alias("object_id"))
    x, y, w = F.col("l_partkey") % 40 / 100.0 - 0.2, F.col("l_suppkey") % 30 / 100.0 - 0.15, 0.02 + F.col("l_quantity") / 1000
    least = li.agg(F.min(x).alias("x"), F.min(y).alias("y"), F.min(w).alias("w"))
    return least.select("scene_id", "object_id", G.centred_rect(F.col("x"), F.col("y"), F.col("w"), F.col("w")).alias("o"))


@define(f"WITH b AS ({BOX}) SELECT a.scene_id, count(*) AS pairs, round(sum(greatest(0, least(a.x + a.w / 2, b.x + b.w / 2) - greatest(a.x - a.w / 2, b.x - b.w / 2)) * greatest(0, least(a.y + a.w / 2, b.y + b.w / 2) - greatest(a.y - a.w / 2, b.y - b.w / 2))), 9) AS area FROM b a JOIN b ON a.scene_id = b.scene_id AND a.object_id < b.object_id GROUP BY a.scene_id")
def aabb_overlap(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    pairs = b.join(b.select("scene_id", F.col("object_id").alias("other"), F.col("o").alias("p")), "scene_id").filter("object_id < other")
    return pairs.groupBy("scene_id").agg(F.count("*").alias("pairs"), F.round(F.sum(G.overlap(F.col("o"), F.col("p"))), 9).alias("area"))


BOUNDS = (-0.3, -0.3, 0.3, 0.3)


def shelf() -> F.Column:
    return G.rect(*(F.lit(b) for b in BOUNDS))


@define(
    f"WITH b AS ({BOX}), m AS (SELECT scene_id, min(x) AS x, min(y) AS y, min(w) AS w FROM b WHERE object_id = 1 GROUP BY scene_id), n AS (SELECT m.scene_id, 0.3 - 0.002 - (m.x + m.w / 2) AS room, (b.x - b.w / 2 - 0.002) - (m.x + m.w / 2) AS t0, (b.x + b.w / 2 + 0.002) - (m.x - m.w / 2) AS t1, (m.y + m.w / 2 <= b.y - b.w / 2 - 0.002 OR m.y - m.w / 2 >= b.y + b.w / 2 + 0.002) AS miss FROM m LEFT JOIN b ON m.scene_id = b.scene_id AND b.object_id > 1) "
    'SELECT scene_id, round(greatest(0, least(0.45, min(room), min(CASE WHEN NOT miss AND t1 > greatest(t0, 0) THEN greatest(t0, 0) END))), 6) AS "limit" FROM n GROUP BY scene_id'
)
def swept_aabb_limit(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    moves = b.filter("object_id = 1").groupBy("scene_id").agg(F.min("o").alias("r")).select("scene_id", "r", F.lit(1.0).alias("vx"), F.lit(0.0).alias("vy"))
    return scene.clearance_limits(moves, b.filter("object_id > 1"), shelf(), []).withColumn("limit", r6(F.col("limit")))


@define(None)
def translation_candidates(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    pick = lambda i, name: b.filter(F.col("object_id") == i).groupBy("scene_id").agg(F.min("o").alias(name))
    scenes = pick(1, "target").join(pick(2, "blocker"), "scene_id")
    out = scene.translation_candidates(scenes, b.filter("object_id > 2").select("scene_id", "o"), shelf(), 0.01)
    return out.withColumns({c: r6(F.col(c)) for c in ("distance", "limit")})


def polygons(spark: SparkSession, sf: str) -> DataFrame:
    """The orders' boxes in centimetres."""
    o = F.col("o")
    corner = F.array(G.point(o["xmin"] * 100, o["ymin"] * 100), G.point(o["xmax"] * 100, o["ymin"] * 100), G.point(o["xmax"] * 100, o["ymax"] * 100), G.point(o["xmin"] * 100, o["ymax"] * 100))
    return boxes(spark, sf).select("scene_id", "object_id", corner.alias("polygon"))


APART = "100 * sqrt(pow(greatest(0, abs(a.x - b.x) - (a.w + b.w) / 2), 2) + pow(greatest(0, abs(a.y - b.y) - (a.w + b.w) / 2), 2))"


@define(f"WITH b AS (SELECT scene_id, object_id, min(x) AS x, min(y) AS y, min(w) AS w FROM ({BOX}) GROUP BY ALL) SELECT a.scene_id, a.object_id AS object_id_a, b.object_id AS object_id_b, round({APART}, 4) AS distance FROM b a JOIN b ON a.scene_id = b.scene_id AND a.object_id < b.object_id AND {APART} <= 5.00001")
def convex_polygon_distance(spark: SparkSession, sf: str) -> DataFrame:
    return scene.near_objects(polygons(spark, sf), 5.00001).withColumn("distance", F.round("distance", 4))


@define(None)
def motion_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """Free space and motion capacity of each scene's first object in four directions.

    No SQL: sides can run through another square's centre here, where rounding decides what
    a ray meets first. ``motion_payloads`` has the same operators on squares where none do.
    """
    p = polygons(spark, sf)
    other = p.filter("object_id > 1").select("scene_id", F.col("polygon").alias("other"))
    pairs = p.filter("object_id = 1").join(other, "scene_id")
    found = scene.least_room(pairs, ("scene_id",), "polygon", "other", list(G.D4.values()), (-30.0, 30.0, -30.0, 30.0), 1.0, 40.0, turns=False)
    each = F.array(*(F.struct(F.lit(a).alias("degrees"), r6(F.col(f"free_{i}")).alias("free"), F.col(f"slide_{i}").alias("capacity")) for i, a in enumerate(G.D4.values())))
    return found.select("scene_id", F.inline(each))


PIX = "SELECT o_custkey % 50 AS scene_id, o_orderkey % 5 AS object_id, o_orderkey * 7 % 40 AS u, o_orderkey * 11 % 30 AS v FROM orders"


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("scene_id"), (k % 5).alias("object_id"), (k * 7 % 40).alias("u"), (k * 11 % 30).alias("v")).distinct()


@define(f"SELECT scene_id, object_id, count(*) AS area, round(avg(u), 6) AS u_mean, round(avg(v), 6) AS v_mean, min(u) AS u_min, max(u) AS u_max, min(v) AS v_min, max(v) AS v_max FROM (SELECT DISTINCT * FROM ({PIX})) GROUP BY ALL")
def mask_summary(spark: SparkSession, sf: str) -> DataFrame:
    return scene.mask_summary(pixels(spark, sf)).withColumns({c: r6(F.col(c)) for c in ("u_mean", "v_mean")})


@define(f"WITH p AS (SELECT DISTINCT * FROM ({PIX})), g AS (SELECT scene_id, object_id, count(*) FILTER (u < 20 OR scene_id % 2 = 0) AS seen_area, count(*) AS full_area FROM p GROUP BY ALL) SELECT *, full_area - seen_area AS differing, CASE WHEN seen_area = 0 THEN 'NOT_VISIBLE' WHEN seen_area = full_area THEN 'FULL' ELSE 'PARTIAL' END AS visibility, round(seen_area / full_area, 6) AS visible_share FROM g")
def visibility_states(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf)
    return scene.visibility(p.filter("u < 20 OR scene_id % 2 = 0"), p).withColumn("visible_share", r6(F.col("visible_share")))


COARSE = f"p AS (SELECT DISTINCT scene_id, object_id, CAST(u // 4 AS BIGINT) AS u, CAST(v // 4 AS BIGINT) AS v FROM ({PIX}))"
#: Each pixel with the first pixels (by row, then column) that it reaches over neighbours, corners too.
REACHED = f"WITH RECURSIVE {COARSE}, r AS (SELECT *, v AS cv, u AS cu FROM p UNION SELECT p.*, r.cv, r.cu FROM r JOIN p ON p.scene_id = r.scene_id AND p.object_id = r.object_id AND abs(p.u - r.u) <= 1 AND abs(p.v - r.v) <= 1 AND (p.v, p.u) > (r.cv, r.cu)), l AS (SELECT scene_id, object_id, u, v, min({{'v': cv, 'u': cu}}) AS c FROM r GROUP BY ALL), a AS (SELECT scene_id, object_id, c, count(*) AS area, min(u) AS \"left\", min(v) AS top, max(u) - min(u) + 1 AS width, max(v) - min(v) + 1 AS height, round(avg(u), 6) AS u_mean, round(avg(v), 6) AS v_mean FROM l GROUP BY ALL), b AS (SELECT *, count(*) OVER m AS components, CAST(sum(area) OVER m AS BIGINT) AS visible_area, row_number() OVER (PARTITION BY scene_id, object_id ORDER BY area DESC, c) AS r FROM a WINDOW m AS (PARTITION BY scene_id, object_id))"


def coarse_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Masks of pixels of four by four, which touch."""
    return pixels(spark, sf).select("scene_id", "object_id", F.floor(F.col("u") / 4).alias("u"), F.floor(F.col("v") / 4).alias("v"))


@define(REACHED + ' SELECT scene_id, object_id, components, visible_area, area, u_mean, v_mean, "left", top, width, height FROM b WHERE r = 1')
def largest_components(spark: SparkSession, sf: str) -> DataFrame:
    """How many connected parts a mask has, and the largest of them."""
    out = masks.largest_components(masks.labelled_runs(coarse_pixels(spark, sf)))
    return out.select("scene_id", "object_id", "components", "visible_area", "area", r6(F.col("u_mean")).alias("u_mean"), r6(F.col("v_mean")).alias("v_mean"), "left", "top", "width", "height")


@define(REACHED + ", k AS (SELECT l.* FROM l JOIN b ON b.r = 1 AND l.scene_id = b.scene_id AND l.object_id = b.object_id AND l.c = b.c), g AS (SELECT x.u, y.v FROM range(-1, 12) x(u), range(-1, 9) y(v)), m AS (SELECT DISTINCT scene_id, object_id FROM k), e AS (SELECT m.*, g.* FROM m, g ANTI JOIN k ON k.scene_id = m.scene_id AND k.object_id = m.object_id AND k.u = g.u AND k.v = g.v), d AS (SELECT k.scene_id, k.object_id, k.u, k.v, min((k.u - e.u) * (k.u - e.u) + (k.v - e.v) * (k.v - e.v)) AS s FROM k JOIN e ON k.scene_id = e.scene_id AND k.object_id = e.object_id GROUP BY ALL) SELECT scene_id, object_id, best.u AS u, best.v AS v, round(sqrt(best.s), 6) AS clearance FROM (SELECT scene_id, object_id, first({'u': u, 'v': v, 's': s} ORDER BY s DESC, v, u) AS best FROM d GROUP BY ALL)")
def deepest_points(spark: SparkSession, sf: str) -> DataFrame:
    """Where a label has most room: the point of a mask's largest part that is farthest from its border."""
    return masks.deepest_points(coarse_pixels(spark, sf)).withColumn("clearance", r6(F.col("clearance")))


@define(f"WITH p AS (SELECT DISTINCT scene_id, object_id, u // 4 AS u, v // 4 AS v FROM ({PIX})), h AS (SELECT scene_id, u, v FROM p WHERE object_id = 0), s AS (SELECT scene_id, count(*) AS target_area FROM h GROUP BY 1), m AS (SELECT scene_id, object_id, count(*) AS overlap FROM h JOIN (SELECT * FROM p WHERE object_id > 0) USING (scene_id, u, v) GROUP BY ALL), r AS (SELECT scene_id, object_id, overlap, target_area, overlap / target_area AS share FROM m JOIN s USING (scene_id) WHERE overlap / target_area >= 0.05) SELECT scene_id, object_id, overlap, target_area, round(share, 6) AS share, row_number() OVER (PARTITION BY scene_id ORDER BY share DESC, object_id) = 1 AS is_primary FROM r")
def occluder_ranking(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf).select("scene_id", "object_id", F.floor(F.col("u") / 4).alias("u"), F.floor(F.col("v") / 4).alias("v")).distinct()
    out = scene.occluders(p.filter("object_id = 0").select("scene_id", "u", "v"), p.filter("object_id > 0"))
    return out.withColumn("share", r6(F.col("share")))


@define(f"WITH p AS (SELECT DISTINCT *, 1 + u / 100 AS depth FROM ({PIX})) SELECT scene_id, object_id, u, v, round((u - 20) / 50.0 * depth + 1, 6) AS x, round(-depth + 2, 6) AS y, round((v - 15) / 50.0 * depth + 3, 6) AS z FROM p")
def backprojection(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf).withColumn("depth", 1 + F.col("u") / 100)
    out = scene.backproject(p, 50.0, 50.0, 20.0, 15.0, [[1, 0, 0], [0, 0, -1], [0, 1, 0]], [1, 2, 3])
    return out.select("scene_id", "object_id", "u", "v", *(r6(F.col(c)).alias(c) for c in "xyz"))


@define(None)
def point_sample(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf).withColumn("point_id", F.col("u") * 100 + F.col("v"))
    return scene.sample_points(p, 32, "points", ("scene_id", "object_id")).select("scene_id", "object_id", "point_id", "slot")
