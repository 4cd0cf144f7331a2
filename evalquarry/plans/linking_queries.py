"""Queries of the linking operators and of aggregates over arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import linking, metrics, scene, vectors
from .catalog import SQL, define, r6, table
from .metric_queries import UNIT, labelled, scored
from .value_queries import ASKED, BOX, PAIRS, SMALL, asked_sql, boxes, shelf


@define("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON replace(c_name, 'Customer#', 'v2_') = 'v2_' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')")
def rekeyed_join(spark: SparkSession, sf: str) -> DataFrame:
    c = linking.rekeyed(table(spark, sf, "customer").withColumnRenamed("c_name", "k"), "k", "Customer#", "v2_")
    o = table(spark, sf, "orders").withColumn("k", F.concat(F.lit("v2_"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")))
    return c.join(o, "k").select("c_custkey", "o_orderkey")


@define("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def covered_subset(spark: SparkSession, sf: str) -> DataFrame:
    return linking.covered_subset(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]).select("doc_id", "n_chars")


STATUS = {"low": "l_quantity < 20", "mid": "l_quantity < 35", "high": "l_discount > 0.03", "all": "l_tax >= 0"}


@define("SELECT l_orderkey, low.m AS low_m, mid.m AS mid_m, high.m AS high_m, a.m AS all_m FROM " + " JOIN ".join(f"(SELECT l_orderkey, max(l_extendedprice) AS m FROM lineitem WHERE {c} GROUP BY 1) {'a' if n == 'all' else n}" + ("" if n == "low" else " USING (l_orderkey)") for n, c in STATUS.items()))
def four_way_join(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    parts = {n: li.filter(c).groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("m")) for n, c in STATUS.items()}
    return linking.side_by_side(parts, ["l_orderkey"], dict.fromkeys(parts, ["m"]))


@define("SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def foreign_key_join(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return linking.referenced(n, table(spark, sf, "region"), "n_regionkey", "r_regionkey", F.col("r_name").isNotNull()).select("n_nationkey", "n_name", "r_regionkey", "r_name")


@define("SELECT count(*) AS paired, count(*) FILTER (a.quality IS NOT DISTINCT FROM b.quality AND a.quality IS NOT DISTINCT FROM b.toxic) AS matching FROM labels a JOIN labels b USING (doc_id)")
def matching_inputs(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "labels")
    return linking.matching_inputs(a.withColumn("x", F.col("quality")), a.withColumn("x", F.col("toxic")), ["doc_id"], ["quality", "x"])


@define("SELECT o_orderpriority, " + ", ".join(f"round(avg(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END), 4) AS \"{s}_price\", count(*) FILTER (o_orderstatus = '{s}') AS \"{s}_n\"" for s in "FOP") + " FROM orders GROUP BY o_orderpriority")
def prefixed_pivot(spark: SparkSession, sf: str) -> DataFrame:
    out = linking.prefixed_pivot(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", list("FOP"), {"price": F.col("o_totalprice")})
    return out.withColumns({f"{s}_price": F.round(f"{s}_price", 4) for s in "FOP"})


@define(f'WITH s AS ({UNIT}), e AS (SELECT user_id, event_type, count(*) FILTER (correct) AS m FROM s GROUP BY ALL), t AS (SELECT user_id, min(m) AS l, count(*) AS c FROM e GROUP BY 1) SELECT event_type, count(*) FILTER (m = 2) AS "all", count(*) FILTER (m > 0 AND m < 2) AS mixed, count(*) FILTER (m = 0) AS "none" FROM e GROUP BY event_type UNION ALL SELECT NULL, count(*) FILTER (l = 2 AND c = 5), count(*) FILTER (l < 2 OR c < 5), 0 FROM t')
def condition_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return linking.condition_agreement(scored(spark, sf), ["user_id"], "event_type", F.col("correct"), 2, 5)


@define("SELECT source, count(*) AS n, count(*) FILTER (CAST(n_chars > 1000 AS INT) IS NOT DISTINCT FROM quality) AS right_before, count(*) FILTER (CAST(n_chars > 1000 AS INT) IS NOT DISTINCT FROM toxic) AS right_now FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def two_truths(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "labels")
    p = table(spark, sf, "documents").select("doc_id", "source", (F.col("n_chars") > 1000).cast("int").alias("p"))
    return linking.two_truths(p, t.withColumn("t", F.col("quality")), t.withColumn("t", F.col("toxic")), ["doc_id"], "p", "t", ["source"])


SETS = "SELECT l_orderkey, list_distinct(list(l_suppkey % 6)) AS a, list_distinct(list(l_partkey % 6)) AS b FROM lineitem GROUP BY l_orderkey"


@define(f"SELECT m[1] AS missing, e[1] AS extra, count(*) AS n FROM (SELECT list_filter(a, lambda x: NOT list_contains(b, x)) AS m, list_filter(b, lambda x: NOT list_contains(a, x)) AS e FROM ({SETS})) WHERE len(m) = 1 AND len(e) = 1 GROUP BY ALL")
def single_substitutions(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 6).alias("a"), F.collect_set(F.col("l_partkey") % 6).alias("b"))
    return linking.single_substitutions(li, F.array_except("a", "b"), F.array_except("b", "a"))


@define(f"SELECT l_orderkey, list_sort(list_distinct(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x))))) AS differing, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset FROM ({SETS})")
def set_differences(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 6).alias("a"), F.collect_set(F.col("l_partkey") % 6).alias("b"))
    return li.select("l_orderkey", A.symmetric_difference(F.col("a"), F.col("b")).alias("differing"), A.is_subset(F.col("a"), F.col("b")).alias("subset"))


@define("SELECT user_id, CASE WHEN user_id % 2 = 0 THEN p ELSE n - p END AS correct FROM (SELECT user_id, count(*) AS n, count(*) FILTER (value > 50) AS p FROM events GROUP BY user_id)")
def conditioned_correct(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("p"))
    return e.select("user_id", linking.conditioned_correct(F.col("p"), F.col("n"), F.col("user_id") % 2 == 0).alias("correct"))


@define(f'WITH p AS (SELECT li AS a, lj AS b, c FROM ({PAIRS}) UNION ALL SELECT lj, li, c FROM ({PAIRS})) SELECT a AS "group", ' + ", ".join(f"round(avg(c) FILTER (b = {d}), 6) AS with_{d}" for d in range(4)) + " FROM p GROUP BY a")
def family_matrix(spark: SparkSession, sf: str) -> DataFrame:
    out = linking.mean_matrix(vectors.group_means(table(spark, sf, "embeddings"), "embedding", "label", 64), "label_i", "label_j", "cosine", range(4))
    return out.withColumns({f"with_{d}": r6(F.col(f"with_{d}")) for d in range(4)})


@define("SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey % 4, n_nationkey) = list(n_nationkey ORDER BY n_nationkey % 8, n_nationkey) AS same_order FROM nation GROUP BY n_regionkey")
def same_order(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").withColumns({"x": F.col("n_nationkey") % 4, "y": F.col("n_nationkey") % 8})
    return linking.same_order(n, ["n_regionkey"], "x", "y", "n_nationkey")


@define("SELECT l_orderkey, min(l_discount) AS least_gap, bool_or(l_linestatus = 'F') AS removed, bool_or(l_returnflag = 'R') AS moved, bool_or(l_linestatus = 'F') OR (bool_or(l_returnflag = 'R') AND min(l_discount) > 0.02) AS clear FROM lineitem GROUP BY l_orderkey")
def post_move_check(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("gap", F.col("l_discount"))
    return linking.post_move_check(li, F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", ["l_orderkey"], 0.02)


@define(f'WITH l AS ({SQL["swept_aabb_limit"]}) SELECT scene_id, CAST(least(8, floor(("limit" + 1e-9) / 0.05)) AS BIGINT) AS n_allowed FROM l')
def action_masks(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf).filter("object_id = 1").groupBy("scene_id").agg(F.min("o").alias("r"))
    moves = b.select("scene_id", "r", F.lit(1.0).alias("vx"), F.lit(0.0).alias("vy"))
    limits = scene.clearance_limits(moves, boxes(spark, sf).filter("object_id > 1"), shelf(), [])
    return linking.action_masks(limits, 0.05, 0.4).select("scene_id", F.col("n_allowed").cast("bigint").alias("n_allowed"))


@define("SELECT o_custkey, to_json(list_sort(list(DISTINCT o_orderstatus))) AS statuses, list(o_orderpriority ORDER BY o_orderkey) AS in_order, bool_and(o_totalprice > 1000) AS every_one, bool_or(o_totalprice > 400000) AS any_one FROM orders GROUP BY o_custkey")
def list_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda s: s["o_orderpriority"])
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_set("o_orderstatus"))).alias("statuses"), ordered.alias("in_order"), F.bool_and(F.col("o_totalprice") > 1000).alias("every_one"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_one"))


@define("SELECT source, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, round(sum(tp) / nullif(sum(tp) + sum(fp), 0), 6) AS precision, round(sum(tp) / nullif(sum(tp) + sum(fn), 0), 6) AS recall, round(coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0), 6) AS f1 FROM (SELECT source, CAST(quality = 1 AND n_chars > 1500 AS INT) AS tp, CAST(quality = 0 AND n_chars > 1500 AS INT) AS fp, CAST(quality = 1 AND n_chars <= 1500 AS INT) AS fn FROM documents JOIN labels USING (doc_id)) GROUP BY source")
def micro_scores(spark: SparkSession, sf: str) -> DataFrame:
    q, p = F.col("quality") == 1, F.col("n_chars") > 1500
    out = metrics.micro_scores(labelled(spark, sf), (q & p).cast("int"), (~q & p).cast("int"), (q & ~p).cast("int"), ["source"], "null")
    return out.withColumns({c: r6(F.col(c)) for c in ("precision", "recall", "f1")})


@define(f"SELECT vec_id_i, vec_id_j, round(x.c - y.c, 6) AS change FROM ({asked_sql(SMALL)}) x JOIN ({asked_sql('SELECT vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS v FROM embeddings')}) y USING (vec_id_i, vec_id_j)")
def matrix_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Every 50th vector against all others, by all components and by the first half of them in one pass."""
    both = vectors.asked_cosines(table(spark, sf, "embeddings"), "vec_id", "embedding", F.expr(ASKED), {"c": slice(None), "d": slice(0, 32)})
    return both.select("vec_id_i", "vec_id_j", r6(F.col("c") - F.col("d")).alias("change"))


@define(f"WITH p AS (SELECT CAST(i // 60 + 1 AS INT) AS layer, li, lj, c FROM ({PAIRS}) WHERE i // 60 = j // 60) SELECT layer, round(avg(c) FILTER (li = lj) - avg(c) FILTER (li <> lj), 6) AS gap FROM p GROUP BY layer")
def layerwise_gap(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumn("layer", (F.floor(F.col("vec_id") / 60) + 1).cast("int"))
    pairs = vectors.cosine_pairs(e, "vec_id", "embedding", ["label"], by=["layer"])
    return vectors.pair_gap(pairs, F.col("label_i") == F.col("label_j"), by=["layer"]).select("layer", r6(F.col("gap")).alias("gap"))


@define("SELECT o_orderkey, two[1] AS p FROM (SELECT o_orderkey, [round(1 / (1 + exp(-(o_totalprice - 200000) / 100000)), 6)] AS two FROM orders)")
def two_way_softmax(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", r6(vectors.two_way((F.col("o_totalprice") - 200000) / 100000)["p"]).alias("p"))


@define("SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_discount) AS r FROM lineitem WHERE l_tax > 0.02) WHERE r = 1")
def preferred_actions(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.preferred(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", "l_discount", F.col("l_tax") > 0.02).select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")


