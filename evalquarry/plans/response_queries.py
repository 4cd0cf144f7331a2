"""Queries of parsed responses: classifiers of errors, rules, pair maps, masks, audits of runs, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import binning as B
from ..functions import cascades as C
from ..functions import geometry as G
from ..functions import rules as R
from ..functions import text as X
from ..operators import audit, linking, metrics, scene, vectors
from .catalog import SQL, define, r6, table
from .value_queries import BOX, boxes, shelf

#: Eleven Boolean columns for each order, from the digits of a number to base two: stand-ins of a response's checks.
FLAG_SQL = "SELECT o_orderkey, " + ", ".join(f"(o_orderkey * 7919 // {2**i}) % 2 = 1 AS f{i}" for i in range(11)) + " FROM orders"


def flags(spark: SparkSession, sf: str) -> tuple[DataFrame, list[Column]]:
    n = F.col("o_orderkey") * 7919
    df = table(spark, sf, "orders").select("o_orderkey", *((F.floor(n / 2**i) % 2 == 1).alias(f"f{i}") for i in range(11)))
    return df, [F.col(f"f{i}") for i in range(11)]


CASCADE_SQL = {
    "listing": "CASE WHEN NOT f0 THEN 'parse_failure' WHEN f1 THEN 'correct' WHEN f2 THEN 'duplicate_output' WHEN f3 AND f4 THEN 'missing_and_extra' WHEN f3 THEN 'missing_only' WHEN f4 THEN 'extra_only' ELSE 'other_content_error' END",
    "inventory": "CASE WHEN NOT f0 THEN 'parse_failure' WHEN NOT f1 THEN 'id_coverage_failure' WHEN f2 THEN 'correct' WHEN f3 THEN 'color_error_only' WHEN f4 THEN 'object_error_only' ELSE 'object_and_color_error' END",
    "request": "CASE WHEN NOT f0 THEN 'parse_failure' WHEN f1 THEN 'correct' WHEN NOT f2 THEN 'request_decomposition_failure' WHEN NOT f3 THEN 'instance_enumeration_failure' WHEN NOT f4 THEN 'truth_table_violation' WHEN NOT f5 THEN 'aggregation_failure' WHEN f6 AND f7 THEN 'joint_object_color_recognition_failure' WHEN f6 THEN 'object_recognition_failure' WHEN f7 THEN 'basic_color_recognition_failure' WHEN f8 THEN 'canonical_color_disagreement' WHEN f9 AND f10 THEN 'joint_type_color_comparison_failure' WHEN f9 THEN 'object_type_comparison_failure' WHEN f10 THEN 'color_comparison_failure' ELSE 'unattributed_target_failure' END",
    "scaffold": "CASE WHEN NOT f0 THEN 'parse_failure' WHEN f1 THEN 'correct' WHEN NOT f2 THEN 'request_decomposition_failure' WHEN NOT f3 THEN 'truth_table_violation' WHEN NOT f4 THEN 'object_type_comparison_failure' WHEN f5 THEN 'gt_target_set_disagreement_with_semantic_inventory_exact' ELSE 'target_failure_with_semantic_error' END",
    "order": "CASE WHEN NOT f0 THEN 'parse_failure' WHEN NOT f1 THEN 'visible_ids_failure' WHEN NOT f2 THEN 'output_permutation_failure' WHEN NOT f3 THEN 'spatial_order_failure' ELSE 'correct' END",
    "pairs": "CASE WHEN NOT f0 THEN 'parse_failure' WHEN NOT f1 THEN 'visible_ids_failure' WHEN NOT f2 THEN 'pairwise_structure_failure' WHEN NOT f3 THEN 'pairwise_relation_failure' ELSE 'correct' END",
    "anchor": "CASE WHEN NOT f0 THEN 'parse_failure' WHEN NOT f1 THEN 'visible_ids_failure' WHEN NOT f2 THEN 'target_id_failure' WHEN NOT f3 THEN 'relation_structure_failure' WHEN NOT f4 THEN 'target_relation_failure' ELSE 'correct' END",
    "action": "CASE WHEN f0 THEN 'SUCCESS' WHEN NOT f1 THEN 'PRECHECK_ERROR' WHEN NOT f2 THEN 'ACTION_WRONG' WHEN NOT f3 THEN 'OBJECT_WRONG' WHEN f5 AND NOT f4 THEN 'DIRECTION_WRONG' WHEN f7 AND NOT f6 THEN 'DISTANCE_WRONG' ELSE 'PHYSICAL_FAILURE_AFTER_GT_MATCH' END",
}


@define(f"WITH f AS ({FLAG_SQL}) " + " UNION ALL ".join(f"SELECT '{name}' AS cascade, {case} AS error, count(*) AS n FROM f GROUP BY 2" for name, case in CASCADE_SQL.items()))
def error_cascades(spark: SparkSession, sf: str) -> DataFrame:
    df, f = flags(spark, sf)
    each = {
        "listing": C.listing_error(*f[:5]), "inventory": C.inventory_error(*f[:5]), "request": C.request_error(*f), "scaffold": C.scaffold_error(*f[:6]), "order": C.order_error(*f[:4]), "pairs": C.pairs_error(*f[:4]),
        "anchor": C.anchor_error(*f[:5]), "action": C.action_error(f[0], f[1], f[2], f[3], F.when(f[5], f[4]), F.when(f[7], f[6])),
    }
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(name).alias("cascade"), label.alias("error")) for name, label in each.items()))).alias("e")).select("e.*")
    return rows.groupBy("cascade", "error").agg(F.count("*").alias("n"))


#: For each order: ids that can be seen, a target, and what a response might name.
ANSWER_SQL = "SELECT l_orderkey, list_sort(list_distinct(list(l_partkey % 9))) AS visible, l_orderkey % 9 AS target, nullif(l_orderkey % 11, 10) AS chosen, list(l_suppkey % 7 ORDER BY l_linenumber, l_suppkey) AS named, CASE WHEN l_orderkey % 3 = 0 THEN 'NONE' ELSE 'PATH' END AS reason, CASE l_orderkey % 4 WHEN 0 THEN 'RETRIEVE' WHEN 1 THEN 'TRANSLATE' WHEN 2 THEN 'ROTATE' ELSE 'LIFT_AND_RELOCATE' END AS action, l_orderkey % 14 AS distance FROM lineitem GROUP BY l_orderkey"


def answers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_orderkey")
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey") % 9)).alias("visible"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("s"))
    action = F.element_at(F.array(*map(F.lit, ("RETRIEVE", *R.MOVES))), (k % 4 + 1).cast("int"))
    return li.select("l_orderkey", "visible", (k % 9).alias("target"), F.nullif(k % 11, F.lit(10)).alias("chosen"), F.transform("s", lambda x: x["l_suppkey"] % 7).alias("named"), F.when(k % 3 == 0, "NONE").otherwise("PATH").alias("reason"), action.alias("action"), (k % 14).alias("distance"))


RULE_SQL = {
    "blockers twice or not ascending": "named <> list_sort(list_distinct(named))",
    "a blocker isn't visible": "len(list_filter(named, lambda b: NOT list_contains(visible, b))) > 0",
    "a blocker is the target": "list_contains(named, target)",
    "no reason but blockers": "reason = 'NONE' AND len(named) > 0",
    "a reason but no blockers": "reason <> 'NONE' AND len(named) = 0",
    "chosen object isn't visible": "chosen IS NOT NULL AND NOT list_contains(visible, chosen)",
    "chosen object is the target": "chosen IS NOT NULL AND chosen = target",
    "retrieves another object": "action = 'RETRIEVE' AND chosen IS DISTINCT FROM target",
    "moves the target": "action <> 'RETRIEVE' AND chosen IS NOT DISTINCT FROM target",
    "distance and its level differ": "action = 'TRANSLATE' AND (CASE WHEN distance <= 0 THEN 'NONE' WHEN distance <= 5 THEN 'SHORT' WHEN distance <= 10 THEN 'MEDIUM' ELSE 'LONG' END) <> 'MEDIUM'",
    "nothing blocks but it doesn't retrieve": "reason = 'NONE' AND NOT (action = 'RETRIEVE' AND chosen IS NOT DISTINCT FROM target)",
    "retrieves in spite of a blocker": "reason <> 'NONE' AND action = 'RETRIEVE'",
    "moves another object than the blocker": "reason <> 'NONE' AND chosen IS DISTINCT FROM named[1]",
    "not ascending": "named <> list_sort(named)",
    "other objects than the visible ones": "list_sort(list_distinct(named)) <> visible",
    "an object twice": "len(named) <> len(list_distinct(named))",
}


@define(f"WITH a AS ({ANSWER_SQL}) " + " UNION ALL ".join(f"""SELECT '{m.replace("'", "''")}' AS rule, count(*) AS broken FROM a WHERE {c} HAVING count(*) > 0""" for m, c in RULE_SQL.items()))
def response_rules(spark: SparkSession, sf: str) -> DataFrame:
    """How often responses break the rules beyond their schema."""
    target, chosen, visible, named, reason, action = (F.col(c) for c in ("target", "chosen", "visible", "named", "reason", "action"))
    sets = R.blocker_set_rules(reason, named, visible, target)
    twice = {"blockers twice or not ascending": sets.pop("a blocker twice") & sets.pop("blockers not ascending")}
    acts = R.action_rules(action, chosen, visible, target, F.col("distance"), F.lit("MEDIUM"), F.lit(None).cast("int"), F.lit("NONE"))
    relation = R.relation_rules(named, F.transform(named, lambda i: F.when(i == target, "TARGET").otherwise("INTERFERES")), visible, target, target)
    relation.pop("number of objects")
    rules = sets | twice | R.single_id_rules(chosen, visible, target) | {k: v for k, v in acts.items() if k != "object isn't visible"} | R.upstream_rules(action, chosen, target, reason, named[0]) | relation
    return metrics.array_frequencies(answers(spark, sf), B.violations(rules), "rule").withColumnRenamed("n", "broken")


@define(f"WITH a AS ({ANSWER_SQL}), e AS (SELECT CASE WHEN list_sort(list_distinct(named)) = visible THEN 'set_exact' WHEN len(visible) = 0 THEN 'false_positive_ids' WHEN len(named) = 0 THEN 'missed_all_ids' WHEN NOT list_has_any(named, visible) THEN 'wrong_replacement_ids' ELSE 'partial_or_extra_ids' END AS set_error, CASE WHEN list_contains(visible, chosen) THEN NULL WHEN chosen IS NULL THEN 'null_miss' ELSE 'wrong_id' END AS single_error FROM a) SELECT set_error, single_error, count(*) AS n FROM e GROUP BY ALL")
def blocker_errors(spark: SparkSession, sf: str) -> DataFrame:
    a = answers(spark, sf)
    return a.groupBy(C.blocker_set_error(F.col("visible"), F.col("named")).alias("set_error"), C.blocker_error(F.col("visible"), F.col("chosen")).alias("single_error")).agg(F.count("*").alias("n"))


@define("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_tax BETWEEN 0.01 AND 0.05")
def accepted_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter(B.within({"l_discount": (0.02, 0.06), "l_tax": (0.01, 0.05)})).select("l_orderkey", "l_linenumber", "l_partkey")


@define("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def pending_capped(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return audit.pending_first(table(spark, sf, "customer"), done, ["c_custkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 25).select("c_custkey")


@define("SELECT s_nationkey, round_even(100.0 * count(*) FILTER (s_acctbal > 9000) / count(*), 3) AS rich, round_even(100.0 * count(*) FILTER (s_acctbal > 9900) / nullif(count(*) FILTER (s_acctbal > 9000), 0), 3) AS or_null, coalesce(round_even(100.0 * count(*) FILTER (s_acctbal > 9900) / nullif(count(*) FILTER (s_acctbal > 9000), 0), 3), 0) AS or_zero FROM supplier GROUP BY s_nationkey")
def percentages(spark: SparkSession, sf: str) -> DataFrame:
    """Rounded percentages with both rules for an empty denominator."""
    b = F.col("s_acctbal")
    out = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count_if(b > 9000).alias("a"), F.count_if(b > 9900).alias("c"))
    a, c = F.col("a"), F.col("c")
    return out.select("s_nationkey", metrics.percentage(a, F.col("n")).alias("rich"), metrics.percentage(c, a).alias("or_null"), metrics.percentage(c, a, empty=0.0).alias("or_zero"))


@define("SELECT l_shipmode, count(*) AS n, count(*) FILTER (l_discount <= 0.05) AS cheap, count(*) FILTER (l_tax > 0.02 AND l_returnflag <> 'R') AS returned FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY l_shipmode")
def mismatch_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Independent mismatch counts, one of them only where it can be compared."""
    li = table(spark, sf, "lineitem").withColumn("l_shipmode", F.concat("l_returnflag", "l_linestatus"))
    return metrics.flag_counts(li, {"cheap": F.col("l_discount") > 0.05, "returned": F.when(F.col("l_tax") > 0.02, F.col("l_returnflag") == "R")}, ["l_shipmode"])


@define("SELECT * FROM (SELECT o_orderstatus, unnest(['rows and priced rows', 'urgent and first-class']) AS metric, unnest([CAST(count(*) AS DOUBLE), count(*) FILTER (o_orderpriority = '1-URGENT')]) AS one, unnest([CAST(count(o_totalprice) AS DOUBLE), sum(CASE WHEN o_orderpriority LIKE '1%' AND o_totalprice > 100000 THEN 1 ELSE 0 END)]) AS other FROM orders GROUP BY o_orderstatus) WHERE one IS DISTINCT FROM other")
def cross_metric_audit(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_orderpriority")
    pairs = {"rows and priced rows": (F.count("*"), F.count("o_totalprice")), "urgent and first-class": (F.count_if(p == "1-URGENT"), F.sum((p.startswith("1") & (F.col("o_totalprice") > 100000)).cast("int")))}
    return audit.cross_metric(table(spark, sf, "orders"), ["o_orderstatus"], pairs)


MASK = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) > 0.15)"


@define(f"SELECT vec_id, len(list_filter(m, lambda x: x)) AS allowed, list_contains(m[1:32], true) AS first_half, list_contains(m[33:64], true) AS second_half, list_position(list_concat(m[33:64], m[1:32]), true) AS first_mirrored FROM (SELECT vec_id, {MASK} AS m FROM embeddings)")
def mask_report(spark: SparkSession, sf: str) -> DataFrame:
    """Acceptable actions of each sample, on either side, and where the first stands in the mirrored scene."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") > 0.15).alias("m"))
    out = e.select("vec_id", A.mask_counts(F.col("m")).alias("c"), F.nullif(F.array_position(A.mirrored_mask(F.col("m")), True), F.lit(0).cast("bigint")).alias("first_mirrored"))
    return out.select("vec_id", F.col("c.allowed").cast("bigint").alias("allowed"), "c.first_half", "c.second_half", F.col("first_mirrored"))


@define("SELECT source, n, b AS before_pct, a AS after_pct, round_even(a - b, 3) AS delta_pp FROM (SELECT source, count(*) AS n, round_even(100.0 * count(*) FILTER (quality = 1) / count(*), 3) AS b, round_even(100.0 * count(*) FILTER (quality = 1 AND toxic = 0) / count(*), 3) AS a FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def rounded_delta(spark: SparkSession, sf: str) -> DataFrame:
    """The difference of two rounded percentages, not the rounded difference."""
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return metrics.rounded_delta(d, F.col("quality") == 1, (F.col("quality") == 1) & (F.col("toxic") == 0), ["source"])


@define("WITH s AS (SELECT o_custkey AS c_custkey, list_sort(list(DISTINCT o_orderstatus)) AS splits FROM orders WHERE o_custkey % 10 > 0 GROUP BY 1), j AS (SELECT c_custkey, splits, u FROM (SELECT c_custkey, 1 AS u FROM customer WHERE c_custkey % 13 > 0) FULL JOIN s USING (c_custkey)) SELECT c_custkey, splits, CASE WHEN splits IS NULL THEN 'missing' WHEN u IS NULL THEN 'unknown' ELSE 'overlap' END AS fault FROM j WHERE splits IS NULL OR u IS NULL OR len(splits) > 1")
def split_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that a partition into splits leaves out, makes up or has twice."""
    o = table(spark, sf, "orders").filter("o_custkey % 10 > 0").withColumnRenamed("o_custkey", "c_custkey")
    return audit.split_cover(table(spark, sf, "customer").filter("c_custkey % 13 > 0"), o, "c_custkey", "o_orderstatus")


@define(f"WITH a AS ({ANSWER_SQL}), r AS (SELECT l_orderkey, reason, list_sort(list_distinct(list_filter(named, lambda x: list_contains(visible, x)))) AS ids FROM a) SELECT l_orderkey, ids, (reason = 'NONE') = (len(ids) = 0) AS holds FROM r")
def restricted_truth(spark: SparkSession, sf: str) -> DataFrame:
    """True ids without those that can't be seen, and whether the reason still fits."""
    return answers(spark, sf).select("l_orderkey", A.restricted(F.col("named"), F.col("visible"), F.col("reason")).alias("r")).select("l_orderkey", "r.ids", "r.holds")


@define("SELECT l_orderkey, l_linenumber AS id, l_partkey AS part FROM lineitem WHERE l_linenumber <> l_orderkey % 7 + 1")
def candidate_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each object of a scene but its target."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("part"))).alias("items"))
    return li.select("l_orderkey", F.inline(A.others(F.col("items"), "id", F.col("l_orderkey") % 7 + 1)))


LATE = "SELECT l_orderkey, l_suppkey % 4 AS k, {f}(l_partkey, (l_linenumber, l_partkey, l_extendedprice)) AS v FROM lineitem GROUP BY ALL"


@define(f"SELECT l_orderkey, unnest(['first', 'last']) AS rule, unnest([a, b]) AS entries FROM (SELECT l_orderkey, list(k || ':' || v ORDER BY k) AS a FROM ({LATE.format(f='arg_min')}) GROUP BY 1) JOIN (SELECT l_orderkey, list(k || ':' || v ORDER BY k) AS b FROM ({LATE.format(f='arg_max')}) GROUP BY 1) USING (l_orderkey)")
def keyed_entries(spark: SparkSession, sf: str) -> DataFrame:
    """An array as a map, where of equal keys the first or the last one counts."""
    s = F.struct("l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_suppkey") % 4).alias("k"))
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(s)).alias("items"))
    shown = lambda entries, k, v: F.array_sort(F.transform(entries, lambda e: F.concat_ws(":", e[k], e[v])))
    both = F.array(
        F.struct(F.lit("first").alias("rule"), shown(A.first_of_key(F.col("items"), "k"), "k", "l_partkey").alias("entries")),
        F.struct(F.lit("last").alias("rule"), shown(F.map_entries(A.map_by(F.col("items"), "k", "l_partkey")), "key", "value").alias("entries")),
    )
    return li.select("l_orderkey", F.inline(both))


#: Pairs of an order's lines as a response might give them: some in the wrong order, of other ids, or with a third id in front.
PAIR_SQL = "SELECT a.l_orderkey, a.l_linenumber AS x, b.l_linenumber AS y, CASE WHEN (a.l_partkey + b.l_partkey) % 17 = 0 THEN 99 WHEN a.l_partkey < b.l_partkey THEN a.l_linenumber ELSE b.l_linenumber END AS front, (a.l_suppkey + b.l_suppkey) % 13 = 0 AS swap FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber"
LINE_SQL = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL"


@define(
    f"WITH d AS ({LINE_SQL}), i AS (SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS target FROM d GROUP BY 1), p AS ({PAIR_SQL}), g AS (SELECT l_orderkey, count(*) FILTER (swap OR front = 99) AS errors FROM p GROUP BY 1), "
    "r AS (SELECT p.l_orderkey, list(y ORDER BY y) FILTER (front = y) AS front, list(y ORDER BY y) FILTER (front = x) AS behind FROM p JOIN i ON p.l_orderkey = i.l_orderkey AND p.x = i.target WHERE NOT swap AND front <> 99 GROUP BY 1) "
    "SELECT i.l_orderkey, coalesce(g.errors, 0) AS errors, coalesce(g.errors, 0) = 0 AS complete, coalesce(r.front, []) AS front, coalesce(r.behind, []) AS behind FROM i LEFT JOIN g USING (l_orderkey) LEFT JOIN r USING (l_orderkey)"
)
def pair_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Pair maps checked against the scene's ids, and the first id's relations that follow from them."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    d = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), "part", "supp"))).alias("s"))

    def pair(p: Column) -> Column:
        a, b = p["a"], p["b"]
        front = F.when((a["part"] + b["part"]) % 17 == 0, 99).when(a["part"] < b["part"], a["id"]).otherwise(b["id"])
        swap = (a["supp"] + b["supp"]) % 13 == 0
        return F.struct(F.when(swap, b["id"]).otherwise(a["id"]).alias("id_a"), F.when(swap, a["id"]).otherwise(b["id"]).alias("id_b"), front.alias("front_id"))

    out = d.select("l_orderkey", F.transform("s", lambda x: x["id"]).alias("ids"), F.transform(A.pairs_in_order(F.col("s")), pair).alias("pairs"))
    out = out.withColumn("m", A.pair_map(F.col("pairs"), F.col("ids"))).withColumn("r", A.relations_from_pairs(F.col("m.fronts"), F.col("ids"), F.col("ids")[0]))
    return out.select("l_orderkey", F.col("m.errors").cast("bigint").alias("errors"), "m.complete", "r.front", "r.behind")


@define("SELECT l_orderkey, coalesce(list(l_linenumber ORDER BY l_linenumber) FILTER (l_returnflag = 'R'), []) AS by_type, coalesce(list(l_linenumber ORDER BY l_linenumber) FILTER (l_discount > 0.05), []) AS by_colour, coalesce(list(l_linenumber ORDER BY l_linenumber) FILTER (l_returnflag = 'R' AND l_discount > 0.05), []) AS by_both, coalesce(list(l_linenumber ORDER BY l_linenumber) FILTER (l_quantity < 0), []) AS absent FROM lineitem GROUP BY l_orderkey")
def query_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Ground truth of queries over a scene: by type, by colour, by both, and of something that isn't there."""
    kind, colour = F.col("l_returnflag") == "R", F.col("l_discount") > 0.05
    return linking.ids_where(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber", {"by_type": kind, "by_colour": colour, "by_both": kind & colour, "absent": F.col("l_quantity") < 0})


@define(f"WITH a AS ({ANSWER_SQL}), l AS (SELECT l_orderkey, list(l_partkey % 9 ORDER BY l_discount, l_partkey % 9) AS o FROM (SELECT DISTINCT l_orderkey, l_partkey, l_discount FROM lineitem) GROUP BY 1) SELECT l_orderkey, list_filter(o, lambda x: list_contains(list_filter(visible, lambda v: v <> target), x)) AS shown, list_sort(list_filter(o, lambda x: list_contains(list_filter(visible, lambda v: v <> target), x))) = list_filter(visible, lambda v: v <> target) AS complete FROM a JOIN l USING (l_orderkey)")
def shown_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of those that may be shown, in order, and whether they are exactly those."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_discount").distinct().groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_partkey") % 9).alias("id"), F.col("l_discount").alias("at"))).alias("items"))
    rest = F.filter("visible", lambda v: v != F.col("target"))
    out = answers(spark, sf).join(items, "l_orderkey").select("l_orderkey", A.shown_ids(F.col("items"), rest, "at", "id").alias("s"))
    return out.select("l_orderkey", F.col("s.order").alias("shown"), "s.complete")


@define("SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE [p_partkey, p_size] END AS ids, CASE WHEN p_size > 40 THEN NULL ELSE p_type END AS second_field, CASE WHEN p_size > 45 THEN 'header' WHEN p_size > 40 THEN 'line 2: expected 2 fields' END AS error FROM part")
def headed_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records below a line of ids, as a response writes them; the header is missing in some and a record bent in others."""
    size = F.col("p_size")
    head = F.when(size <= 45, F.concat(F.lit("visible_ids: ["), F.concat_ws(", ", "p_partkey", "p_size"), F.lit("]")))
    text = F.concat_ws("\n", head, F.lit("  "), F.concat_ws(" | ", "p_name", "p_type"), F.when(size > 40, F.lit("bent")))
    out = table(spark, sf, "part").select("p_partkey", X.headed_records(text, 2).alias("h"))
    return out.select("p_partkey", "h.ids", F.col("h.records")[0][1].alias("second_field"), "h.error")


@define("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax < 0.05 AND l_returnflag <> 'A' THEN CASE WHEN l_linestatus = 'F' THEN l_discount > 0.02 AND l_quantity > 10 ELSE l_discount > 0.05 AND l_quantity > 25 END ELSE false END AS valid FROM lineitem")
def action_validity(spark: SparkSession, sf: str) -> DataFrame:
    d, q = F.col("l_discount"), F.col("l_quantity")
    valid = linking.action_validity(F.col("l_linestatus") == "F", d > 0.02, q > 10, d > 0.05, q > 25, F.col("l_tax") >= 0.05, F.col("l_returnflag") == "A")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", valid.alias("valid"))


@define("SELECT n_nationkey, a.s AS left_s, b.s AS right_s, c.s AS third_s FROM (SELECT s_nationkey AS n_nationkey, max(s_acctbal) AS s FROM supplier GROUP BY 1) a JOIN (SELECT c_nationkey AS n_nationkey, max(c_acctbal) AS s FROM customer GROUP BY 1) b USING (n_nationkey) JOIN (SELECT n_nationkey, n_regionkey * 1.5 AS s FROM nation) c USING (n_nationkey)")
def renamed_three_way_join(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("best"))
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("top"))
    n = table(spark, sf, "nation").select("n_nationkey", (F.col("n_regionkey") * 1.5).alias("r"))
    return linking.renamed_join({"left": (s, {"s_nationkey": "n_nationkey", "best": "s"}), "right": (c, {"c_nationkey": "n_nationkey", "top": "s"}), "third": (n, {"r": "s"})}, ["n_nationkey"], ["s"])


@define("SELECT event_id, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def column_or_nested(spark: SparkSession, sf: str) -> DataFrame:
    """A factor that is a column of its own in one version of a log and a field of a struct in another."""
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), F.from_json("props", "k bigint, kind string").alias("factors"))
    return e.select("event_id", linking.column_or_nested(e, "kind", "factors").alias("kind"), linking.column_or_nested(e, "k", "factors").alias("k"))


@define("SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(v, '') <> 'FULL' AND near THEN 'BOTH' WHEN coalesce(v, '') <> 'FULL' THEN 'OCCLUSION' WHEN near THEN 'CLEARANCE_OVERLAP' ELSE 'NONE' END AS reason, coalesce(v, '') = 'FULL' AND NOT coalesce(near, false) AS direct FROM (SELECT l_orderkey, l_linenumber, [NULL, 'FULL', 'PARTIAL', 'FULL'][1 + l_partkey % 4] AS v, CASE WHEN l_suppkey % 5 > 0 THEN l_discount > 0.05 END AS near FROM lineitem)")
def blocking_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an object's visibility, its neighbours or both are in the way."""
    seen = F.get(F.array(F.lit(None), F.lit("FULL"), F.lit("PARTIAL"), F.lit("FULL")), (F.col("l_partkey") % 4).cast("int"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", seen.alias("v"), F.when(F.col("l_suppkey") % 5 > 0, F.col("l_discount") > 0.05).alias("near"))
    hidden = ~F.col("v").eqNullSafe(F.lit("FULL"))
    return li.select("l_orderkey", "l_linenumber", C.blocking_reason(hidden, F.col("near")).alias("reason"), (F.col("v").eqNullSafe(F.lit("FULL")) & ~F.coalesce("near", F.lit(False))).alias("direct"))


STATIC_SQL = f"WITH l AS ({SQL['swept_aabb_limit']}), b AS ({BOX}), m AS (SELECT scene_id, min(x) AS x, min(y) AS y, min(w) AS w FROM b WHERE object_id = 1 GROUP BY scene_id), t AS (SELECT scene_id, min(x) AS tx, min(y) AS ty, min(w) AS tw FROM b WHERE object_id = 2 GROUP BY scene_id), g AS (SELECT *, greatest(0, least(m.x + 0.05 + m.w / 2, tx + tw / 2 + 0.01) - greatest(m.x + 0.05 - m.w / 2, tx - tw / 2 - 0.01)) * greatest(0, least(m.y + m.w / 2, ty - tw / 2) - greatest(m.y - m.w / 2, -0.3)) AS area FROM m JOIN t USING (scene_id) JOIN l USING (scene_id)) "


@define(STATIC_SQL + 'SELECT scene_id, round(area, 9) AS corridor_overlap, area <= 1e-10 AS corridor_clear, "limit" AS clearance_limit, 0.05 < "limit" AND x + 0.05 + w / 2 <= 0.298 AND x + 0.05 - w / 2 >= -0.298 AND y - w / 2 >= -0.298 AND y + w / 2 <= 0.298 AS collision_free FROM g')
def static_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Whether sliding each scene's first object 5 cm to the right would clear the second one's way out."""
    b = boxes(spark, sf)
    pick = lambda i, name: b.filter(F.col("object_id") == i).groupBy("scene_id").agg(F.min("o").alias(name))
    moves = pick(1, "blocker").join(pick(2, "target"), "scene_id").select("scene_id", "target", "blocker", F.lit(1.0).alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.05).alias("distance"))
    out = scene.static_validity(moves, b.filter("object_id > 2"), shelf(), 0.01)
    return out.select("scene_id", F.round("corridor_overlap", 9).alias("corridor_overlap"), "corridor_clear", r6(F.col("clearance_limit")).alias("clearance_limit"), "collision_free")


LOSS_SQL = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS l, list_transform(range(1, 65), lambda i: (vec_id + i) % 5 = 0) AS a FROM embeddings), s AS (SELECT vec_id, l, ln(list_sum(list_transform(l, lambda x: exp(x)))) AS total, list_filter(l, lambda x, i: a[i]) AS good, list_filter(l, lambda x, i: NOT a[i]) AS bad FROM e) "


@define(LOSS_SQL + "SELECT vec_id, round(total - ln(list_sum(list_transform(good, lambda x: exp(x)))), 6) AS nll, round(greatest(list_max(bad) - list_max(good) + 0.5, 0), 6) AS ranking, round(total - 0.9 * l[1] - 0.1 * list_sum(l) / 64, 6) AS smoothed, round(CASE WHEN abs(l[2]) < 0.1 THEN l[2] * l[2] / 0.2 ELSE abs(l[2]) - 0.05 END, 6) AS smooth_l1, round(pow(greatest(0.0 - l[3], l[3] - 0.05, 0), 2) / 2, 6) AS interval FROM s")
def decision_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Losses of a head with several acceptable entries, for each sample."""
    k = F.col("vec_id")
    e = table(spark, sf, "embeddings").select(k, F.col("embedding").cast("array<double>").alias("l"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (k + i) % 5 == 0).alias("a"))
    l, a = F.col("l"), F.col("a")  # noqa: E741
    return e.select("vec_id", r6(vectors.acceptable_nll(l, a)).alias("nll"), r6(vectors.ranking_loss(l, a, 0.5)).alias("ranking"), r6(vectors.cross_entropy(l, F.lit(0), 0.1)).alias("smoothed"), r6(vectors.smooth_l1(l[1], 0.1)).alias("smooth_l1"), r6(vectors.interval_loss(l[2], F.lit(0.0), F.lit(0.05))).alias("interval"))


SEGMENT_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 40 AS x, l_suppkey % 30 AS y, l_quantity / 5 AS d FROM lineitem"


@define(f"WITH s AS ({SEGMENT_SQL}) SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN x <= 20 AND x + d >= 20 AND y BETWEEN 5 AND 25 THEN 0 ELSE sqrt(pow(greatest(x - 20, 20 - (x + d), 0), 2) + pow(greatest(y - 25, 5 - y, 0), 2)) END, 6) AS apart FROM s")
def segment_distances(spark: SparkSession, sf: str) -> DataFrame:
    """A level segment's distance from an upright one."""
    li = table(spark, sf, "lineitem")
    x, y, d = F.col("l_partkey") % 40, F.col("l_suppkey") % 30, F.col("l_quantity") / 5
    level = F.struct(G.point(x.cast("double"), y.cast("double")).alias("a"), G.point(x + d, y.cast("double")).alias("b"))
    upright = F.struct(G.point(F.lit(20.0), F.lit(5.0)).alias("a"), G.point(F.lit(20.0), F.lit(25.0)).alias("b"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", r6(G.segment_distance(level, upright)).alias("apart"))


