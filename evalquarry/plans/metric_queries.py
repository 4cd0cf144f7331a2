"""Queries of the metrics, paired, ranking and audit operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binning as B
from ..operators import audit, metrics, paired, ranking
from ..sources.io import matrix
from .catalog import define, r6, table
from .evaluation import condition_metrics, evaluate

UNIT = "SELECT user_id, event_type, CAST(ts AS DATE) AS day, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) > 100 AS correct FROM events GROUP BY ALL"
#: The exact test in SQL: the same recurrence, as a sum over a list.
BINOMIAL = "CASE WHEN {a} + {b} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, CAST(least({a}, {b}) AS BIGINT) + 1), lambda k: exp(lgamma({a} + {b} + 1) - lgamma(k + 1) - lgamma({a} + {b} - k + 1) - ({a} + {b}) * ln(2))))) END"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return evaluate(events, ["user_id", "event_type", "day"], [F.col("ts"), F.col("event_id")], F.col("value") > 100)


@define(
    f"WITH s AS ({UNIT}), b AS (SELECT user_id, day, correct AS base FROM s WHERE event_type = 'view'), p AS (SELECT s.event_type, s.correct, b.base FROM s JOIN b USING (user_id, day) WHERE event_type <> 'view'), "
    "g AS (SELECT event_type, count(*) AS paired_n, avg(CAST(correct AS INT)) AS accuracy, avg(CAST(base AS INT)) AS baseline_accuracy, count(*) FILTER (correct AND NOT base) AS gained, count(*) FILTER (NOT correct AND base) AS lost FROM p GROUP BY event_type) "
    f"SELECT event_type, paired_n, round(accuracy, 6) AS accuracy, round(baseline_accuracy, 6) AS baseline_accuracy, gained, lost, round(accuracy - baseline_accuracy, 6) AS delta, round({BINOMIAL.format(a='gained', b='lost')}, 9) AS p_value FROM g"
)
def mcnemar_exact(spark: SparkSession, sf: str) -> DataFrame:
    out = condition_metrics(scored(spark, sf), ["user_id", "day"], "event_type", "view")
    return out.withColumns({c: r6(F.col(c)) for c in ("accuracy", "baseline_accuracy", "delta")}).withColumn("p_value", F.round("p_value", 9))


@define("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id, event_type")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.latest(table(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "ts")


@define("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def first_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.first_of(table(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@define("SELECT l_orderkey, l_partkey, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys_audit(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@define("SELECT doc_id, CASE WHEN b IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT DISTINCT doc_id, 1 AS a FROM documents) FULL JOIN (SELECT DISTINCT doc_id, 1 AS b FROM labels) USING (doc_id) WHERE a IS NULL OR b IS NULL")
def missing_extra_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.completeness(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@define("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def pending_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return audit.pending(table(spark, sf, "orders"), done, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@define("SELECT r_regionkey, n_nationkey, o_orderpriority FROM region, nation, (SELECT DISTINCT o_orderpriority FROM orders)")
def schedule_cross_join(spark: SparkSession, sf: str) -> DataFrame:
    return audit.schedule(table(spark, sf, "region").select("r_regionkey"), table(spark, sf, "nation").select("n_nationkey"), table(spark, sf, "orders").select("o_orderpriority").distinct())


LABELLED = "SELECT lang, quality = 1 AS t, n_chars >= 1000 AS p FROM documents JOIN labels USING (doc_id)"
RATES = "tp, fp, fn, tn, tp + fp + fn + tn AS n, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS precision, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"
COUNTS = "count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn"
RATE_NAMES = ("accuracy", "recall", "specificity", "precision", "balanced_accuracy", "f1")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf, "labels"), "doc_id")


@define(f"SELECT lang, {RATES} FROM (SELECT lang, {COUNTS} FROM ({LABELLED}) GROUP BY lang)")
def binary_confusion(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.binary_metric(labelled(spark, sf), F.col("quality") == 1, F.col("n_chars") >= 1000, ["lang"])
    return out.withColumns({c: r6(F.col(c)) for c in RATE_NAMES})


@define(f"SELECT version, {RATES} FROM (SELECT version, {COUNTS} FROM (SELECT doc_id, quality = 1 AS t FROM labels) JOIN (SELECT doc_id, n_chars >= 500 AS p, 'short' AS version FROM documents UNION ALL SELECT doc_id, n_chars >= 2000, 'long' FROM documents) USING (doc_id) GROUP BY version)")
def rescored_versions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    versions = {name: docs.select("doc_id", (F.col("n_chars") >= n).alias("p")) for name, n in (("short", 500), ("long", 2000))}
    out = metrics.rescored(versions, table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("t")), ["doc_id"], "t", "p")
    return out.withColumns({c: r6(F.col(c)) for c in RATE_NAMES})


@define(
    "WITH d AS (SELECT lang, CASE WHEN doc_id % 3 > 0 THEN doc_id % 7 END AS t, CASE WHEN doc_id % 4 > 0 THEN doc_id % 5 END AS p FROM documents), g AS (SELECT lang, count(*) AS n, count(*) FILTER (t IS NOT DISTINCT FROM p) AS exact, count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) AS both_present, count(*) FILTER (t <> p) AS wrong_id, count(*) FILTER (t IS NOT NULL AND p IS NULL) AS missed, count(*) FILTER (t IS NULL AND p IS NOT NULL) AS invented, count(*) FILTER (t IS NULL AND p IS NULL) AS both_null FROM d GROUP BY lang) SELECT *, round(both_present / (both_present + invented), 6) AS presence_precision, round(both_present / (both_present + missed), 6) AS presence_recall FROM g"
)
def presence_confusion(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    out = metrics.presence_metric(table(spark, sf, "documents"), F.when(i % 3 > 0, i % 7), F.when(i % 4 > 0, i % 5), ["lang"])
    return out.withColumns({c: r6(F.col(c)) for c in ("presence_precision", "presence_recall")})


@define("SELECT q.quality, count(*) FILTER (l.toxic = 0) AS pred_0, count(*) FILTER (l.toxic = 1) AS pred_1, count(*) FILTER (l.toxic = 2) AS pred_2 FROM (SELECT unnest([0, 1, 2]) AS quality) q LEFT JOIN labels l ON q.quality = l.quality GROUP BY q.quality")
def confusion_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(table(spark, sf, "labels"), "quality", "toxic", [0, 1, 2])


FLAGS = ["A", "N", "R"]


@define("SELECT l_linestatus, " + ", ".join(f"count(*) FILTER (l_returnflag = '{f}') AS \"{f}_n\", count(*) FILTER (l_returnflag = '{f}' AND l_discount > 0.05) AS \"{f}_correct\", round(avg(CASE WHEN l_returnflag = '{f}' THEN CAST(l_discount > 0.05 AS INT) END), 6) AS \"{f}_accuracy\"" for f in FLAGS) + " FROM lineitem GROUP BY l_linestatus")
def wide_pivot(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.wide_metrics(table(spark, sf, "lineitem"), ["l_linestatus"], "l_returnflag", FLAGS, F.col("l_discount") > 0.05)
    return out.withColumns({f"{f}_accuracy": r6(F.col(f"{f}_accuracy")) for f in FLAGS})


LEVEL = "count(*) AS n, count(*) FILTER (l_discount > 0.05) AS correct_n, round(avg(CAST(l_discount > 0.05 AS INT)), 6) AS accuracy FROM lineitem GROUP BY GROUPING SETS "


def level_aggs() -> tuple:
    return F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("correct_n"), r6(F.avg((F.col("l_discount") > 0.05).cast("int"))).alias("accuracy")


@define(f"SELECT l_returnflag, l_linestatus, CASE grouping(l_returnflag, l_linestatus) WHEN 3 THEN 'overall' WHEN 1 THEN 'l_returnflag' WHEN 2 THEN 'l_linestatus' ELSE 'l_returnflag x l_linestatus' END AS scope, {LEVEL}((), (l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))")
def grouping_sets_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.grouped_levels(table(spark, sf, "lineitem"), [[], ["l_returnflag"], ["l_linestatus"], ["l_returnflag", "l_linestatus"]], *level_aggs())


@define(f"SELECT CASE grouping(l_returnflag) WHEN 0 THEN 'l_returnflag' ELSE 'l_linestatus' END AS factor, coalesce(l_returnflag, l_linestatus) AS value, {LEVEL}((l_returnflag), (l_linestatus))")
def main_effects(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.main_effects(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], *level_aggs())


EACH = "SELECT event_type, user_id, count(*) AS n, count(*) FILTER (value > 50) AS c FROM events GROUP BY ALL"


@define(f'SELECT event_type, count(*) AS units, count(*) FILTER (n = 5 AND c = n) AS "all", count(*) FILTER (n = 5 AND c > 0 AND c < n) AS some, count(*) FILTER (n = 5 AND c = 0) AS "none" FROM ({EACH}) GROUP BY event_type')
def k_of_n_stability(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.stability(table(spark, sf, "events"), ["user_id"], F.col("value") > 50, 5, ["event_type"])


@define(f'SELECT event_type, count(*) AS units, count(*) FILTER (c = n) AS "all", count(*) FILTER (c > 0 AND c < n) AS some, count(*) FILTER (c = 0) AS "none" FROM ({EACH}) GROUP BY event_type')
def any_size_stability(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.stability(table(spark, sf, "events"), ["user_id"], F.col("value") > 50, 5, ["event_type"], need_size=False)


@define(f"SELECT event_type, c AS successes, count(*) AS units FROM ({EACH}) GROUP BY ALL")
def success_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.success_histogram(table(spark, sf, "events"), ["user_id"], F.col("value") > 50, ["event_type"])


@define("SELECT o_custkey, count(*) AS n, count(DISTINCT coalesce(nullif(o_orderstatus, 'P'), '?')) AS distinct_values, count(DISTINCT coalesce(nullif(o_orderstatus, 'P'), '?')) = 1 AS unanimous FROM orders GROUP BY o_custkey")
def unanimity(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.unanimity(table(spark, sf, "orders"), ["o_custkey"], F.nullif(F.col("o_orderstatus"), F.lit("P")))


@define("SELECT user_id, event_type AS majority, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS f FROM events GROUP BY ALL)) WHERE r = 1")
def majority_label(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.majority(table(spark, sf, "events"), ["user_id"], "event_type", F.col("event_id"))


@define("SELECT user_id, c, n, CASE WHEN c = n THEN 'all_correct' WHEN c = 0 THEN 'all_wrong' ELSE 'mixed' END AS bucket FROM (SELECT user_id, count(*) AS n, count(*) FILTER (value > 20) AS c FROM events GROUP BY user_id)")
def outcome_bucket(spark: SparkSession, sf: str) -> DataFrame:
    each = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("c"))
    return each.withColumn("bucket", B.outcome_bucket(F.col("c"), F.col("n")))


@define("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 8")
def first_k_examples(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.first_k(table(spark, sf, "documents"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 8).select("lang", "doc_id")


@define("SELECT p_brand, count(*) AS n, round(avg(p_size), 6) AS mean, median(p_size) AS median, min(p_size) AS min, max(p_size) AS max, round(stddev_pop(p_size), 6) AS sd FROM part GROUP BY p_brand")
def describe_pop(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.describe(table(spark, sf, "part"), F.col("p_size"), ["p_brand"]).withColumns({"mean": r6(F.col("mean")), "sd": r6(F.col("sd"))})


@define("SELECT p_brand, p_type, count(*) AS n, round(avg(p_size), 6) AS mean, median(p_size) AS median, min(p_size) AS min, max(p_size) AS max, round(coalesce(stddev_samp(p_size), 0), 6) AS sd FROM part GROUP BY ALL")
def describe_samp(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.describe(table(spark, sf, "part"), F.col("p_size"), ["p_brand", "p_type"], sample=True).withColumns({"mean": r6(F.col("mean")), "sd": r6(F.col("sd"))})


@define("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS p{q * 100:g}" for q in (0, 0.25, 0.5, 0.75, 0.9, 1)) + " FROM lineitem GROUP BY l_returnflag")
def percentiles_linear(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.percentiles(table(spark, sf, "lineitem"), F.col("l_extendedprice"), [0, 0.25, 0.5, 0.75, 0.9, 1], ["l_returnflag"])
    return out.select("l_returnflag", *(r6(F.col(c)).alias(c) for c in out.columns if c != "l_returnflag"))


@define("SELECT round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.999), 6) AS p99_9 FROM lineitem")
def percentiles_overall(spark: SparkSession, sf: str) -> DataFrame:
    """All rows are one group."""
    out = metrics.percentiles(table(spark, sf, "lineitem"), F.col("l_extendedprice"), [0.1, 0.5, 0.999])
    return out.select(*(r6(F.col(c)).alias(c) for c in out.columns))


@define("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem GROUP BY l_returnflag")
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(r6(F.corr("l_quantity", "l_extendedprice")).alias("pearson"))


@define("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus NOT IN ('F', 'O') OR o_orderstatus IS NULL) AS \"INVALID\", round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS positive_rate FROM orders GROUP BY o_orderpriority")
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.distribution(table(spark, sf, "orders"), F.col("o_orderstatus"), ["F", "O"], ["o_orderpriority"], "F").withColumn("positive_rate", r6(F.col("positive_rate")))


@define("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY value")
def array_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.array_frequencies(table(spark, sf, "part"), F.split("p_name", " "))


@define(
    "WITH tr AS (SELECT * FROM orders WHERE o_orderkey % 5 > 0), te AS (SELECT * FROM orders WHERE o_orderkey % 5 = 0), l AS (SELECT o_orderstatus AS constant_label FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), v AS (SELECT avg(o_totalprice) AS constant_value FROM tr) SELECT constant_label, round(constant_value, 4) AS constant_value, count(*) AS n, round(avg(CAST(o_orderstatus = constant_label AS INT)), 6) AS label_accuracy, round(avg(abs(o_totalprice - constant_value)), 4) AS value_mae FROM te, l, v GROUP BY constant_label, constant_value"
)
def constant_baseline(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    out = metrics.constant_baseline(o.filter("o_orderkey % 5 > 0"), o.filter("o_orderkey % 5 = 0"), "o_orderstatus", "o_totalprice")
    return out.withColumns({"constant_value": F.round("constant_value", 4), "label_accuracy": r6(F.col("label_accuracy")), "value_mae": F.round("value_mae", 4)})


@define("SELECT l_returnflag, count(*) AS n, round(avg(abs(e)), 4) AS mae, round(avg(e), 4) AS bias, round(sqrt(avg(e * e)), 4) AS rmse, round(max(abs(e)), 4) AS worst FROM (SELECT l_returnflag, 1500 * l_quantity - l_extendedprice AS e FROM lineitem) GROUP BY l_returnflag")
def regression_errors(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.regression_errors(table(spark, sf, "lineitem"), 1500 * F.col("l_quantity"), F.col("l_extendedprice"), ["l_returnflag"])
    return out.withColumns({c: F.round(c, 4) for c in ("mae", "bias", "rmse", "worst")})


@define("SELECT l_returnflag, count(*) AS n, round(avg(CAST(off = 0 AS INT)), 6) AS hit_rate, round(avg(off), 4) AS violation FROM (SELECT l_returnflag, greatest(1000 * l_quantity - l_extendedprice, l_extendedprice - 2000 * l_quantity, 0) AS off FROM lineitem) GROUP BY l_returnflag")
def interval_hits(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    out = metrics.interval_hits(table(spark, sf, "lineitem"), F.col("l_extendedprice"), 1000 * q, 2000 * q, ["l_returnflag"])
    return out.withColumns({"hit_rate": r6(F.col("hit_rate")), "violation": F.round("violation", 4)})


@define("SELECT source, count(*) FILTER (toxic = 0) AS population, round(coalesce(avg(CASE WHEN toxic = 0 THEN quality END), 0), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY source")
def conditional_rate(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.conditional_rate(labelled(spark, sf), F.col("toxic") == 0, F.col("quality") == 1, ["source"], 0.0).withColumn("rate", r6(F.col("rate")))


@define("SELECT source, arg_max(doc_id, (quality, toxic, doc_id)) AS doc_id FROM documents JOIN labels USING (doc_id) GROUP BY source")
def best_by_score(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.best_row(labelled(spark, sf), ["source"], [F.col("quality"), F.col("toxic"), F.col("doc_id")]).select("source", "doc_id")


@define(f"WITH s AS ({UNIT}) SELECT user_id, day, s.event_type, s.correct, b.correct AS baseline FROM s LEFT JOIN (SELECT user_id, day, correct FROM s WHERE event_type = 'view') b USING (user_id, day)")
def baseline_window(spark: SparkSession, sf: str) -> DataFrame:
    return paired.with_baseline(scored(spark, sf), ["user_id", "day"], "event_type", "view", "correct").select("user_id", "day", "event_type", "correct", "baseline")


@define(f"WITH s AS ({UNIT}), w AS (SELECT user_id, day, bool_or(correct) FILTER (event_type = 'view') AS l, bool_or(correct) FILTER (event_type = 'click') AS r FROM s GROUP BY ALL), g AS (SELECT count(*) AS paired_n, count(*) FILTER (l AND r) AS both, count(*) FILTER (l AND NOT r) AS left_only, count(*) FILTER (NOT l AND r) AS right_only, count(*) FILTER (NOT l AND NOT r) AS neither FROM w WHERE l IS NOT NULL AND r IS NOT NULL) SELECT *, round((right_only - left_only) * 100 / paired_n, 6) AS delta_points, round({BINOMIAL.format(a='left_only', b='right_only')}, 9) AS p_value FROM g")
def paired_two_by_two(spark: SparkSession, sf: str) -> DataFrame:
    out = paired.paired_table(scored(spark, sf), ["user_id", "day"], "event_type", "view", "click", "correct")
    return out.withColumns({"delta_points": r6(F.col("delta_points")), "p_value": F.round("p_value", 9)})


TYPES = ["signup", "purchase", "error", "view", "click"]


@define(
    f"WITH s AS ({UNIT}), t AS (SELECT *, list_position(['signup', 'purchase', 'error', 'view', 'click'], event_type) AS o FROM s), p AS (SELECT a.event_type AS \"left\", b.event_type AS \"right\", a.correct AS l, b.correct AS r FROM t a JOIN t b ON a.user_id = b.user_id AND a.day = b.day AND a.o < b.o), "
    "g AS (SELECT \"left\", \"right\", count(*) AS paired_n, count(*) FILTER (l AND r) AS both, count(*) FILTER (l AND NOT r) AS left_only, count(*) FILTER (NOT l AND r) AS right_only, count(*) FILTER (NOT l AND NOT r) AS neither FROM p GROUP BY 1, 2) "
    f"SELECT *, round({BINOMIAL.format(a='left_only', b='right_only')}, 9) AS p_value FROM g"
)
def all_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    return paired.contrasts(scored(spark, sf), ["user_id", "day"], "event_type", TYPES, "correct").withColumn("p_value", F.round("p_value", 9))


ORDER_PAIR = "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), p AS (SELECT a.o_orderpriority AS g, a.o_orderstatus AS x, b.o_orderstatus AS y, c.o_orderstatus AS z FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.k = 2 JOIN o c ON a.o_custkey = c.o_custkey AND c.k = 3 WHERE a.k = 1) "


def order_triples(spark: SparkSession, sf: str) -> DataFrame:
    few = metrics.first_k(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderkey")], 3)
    three = few.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))), lambda s: F.struct(s["o_orderstatus"].alias("s"), s["o_orderpriority"].alias("g"))).alias("a")).filter(F.size("a") == 3)
    return three.select(F.col("a")[0]["g"].alias("g"), *(F.col("a")[i]["s"].alias(n) for i, n in enumerate("xyz")))


@define(ORDER_PAIR + "SELECT g, count(*) FILTER (x IN ('F', 'O') AND y IN ('F', 'O')) AS valid, count(*) FILTER (NOT (x IN ('F', 'O') AND y IN ('F', 'O'))) AS invalid, count(*) FILTER (x = 'F' AND y = 'F') AS unchanged_a, count(*) FILTER (x = 'O' AND y = 'O') AS unchanged_b, count(*) FILTER (x = 'F' AND y = 'O') AS a_to_b, count(*) FILTER (x = 'O' AND y = 'F') AS b_to_a, count(*) FILTER (x = 'F' AND y = 'O') - count(*) FILTER (x = 'O' AND y = 'F') AS net_to_b FROM p GROUP BY g")
def paired_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return paired.transitions(order_triples(spark, sf), F.col("x"), F.col("y"), "F", "O", ["g"])


@define(ORDER_PAIR + "SELECT g, count(*) AS n, count(*) FILTER (x <> y) AS changed, count(*) FILTER (x <> y AND x = z) AS toward, count(*) FILTER (x <> y AND y = z) AS away FROM p GROUP BY g")
def toward_reference(spark: SparkSession, sf: str) -> DataFrame:
    return paired.toward_reference(order_triples(spark, sf), F.col("x"), F.col("y"), F.col("z"), ["g"])


@define(ORDER_PAIR + "SELECT g, count(*) FILTER (x = 'F' AND y = 'F') AS kept, count(*) FILTER (x <> 'F' AND y = 'F') AS gained, count(*) FILTER (x = 'F' AND y <> 'F') AS lost, count(*) FILTER (x <> 'F' AND y <> 'F') AS still_wrong, count(*) FILTER (x <> y) AS changed_status FROM p GROUP BY g")
def correctness_transitions(spark: SparkSession, sf: str) -> DataFrame:
    t = order_triples(spark, sf)
    return paired.correctness_transitions(t, F.col("x") == "F", F.col("y") == "F", {"status": (F.col("x"), F.col("y"))}, ["g"])


@define("WITH a AS (SELECT n_regionkey, nullif(n_nationkey % 3, 0) AS k, count(*) AS n FROM nation GROUP BY ALL), b AS (SELECT n_regionkey, nullif(n_nationkey % 3, 0) AS k, max(n_nationkey) AS m FROM nation GROUP BY ALL) SELECT a.n_regionkey, a.k, a.n, b.m AS m_right FROM a JOIN b ON a.n_regionkey = b.n_regionkey AND a.k IS NOT DISTINCT FROM b.k")
def null_safe_join(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").withColumn("k", F.nullif(F.col("n_nationkey") % 3, F.lit(0)))
    return paired.null_safe_pairs(n.groupBy("n_regionkey", "k").agg(F.count("*").alias("n")), n.groupBy("n_regionkey", "k").agg(F.max("n_nationkey").alias("m")), ["n_regionkey", "k"], ["m"])


@define("SELECT p_brand, count(*) AS n, round(coalesce(corr(x, y), 0), 6) AS rho FROM (SELECT p_brand, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS DOUBLE) AS x, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS DOUBLE) AS y FROM part) GROUP BY p_brand")
def spearman_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.spearman(table(spark, sf, "part"), "p_size", "p_retailprice", ["p_brand"]).withColumn("rho", r6(F.col("rho")))


@define("SELECT p_partkey, sha256('seed7' || chr(0) || p_partkey) AS shuffle_key FROM part")
def stable_hash_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.shuffled(table(spark, sf, "part"), "seed7", F.col("p_partkey")).select("p_partkey", "shuffle_key")


@define("SELECT n_nationkey, 'region_' || lpad(CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS VARCHAR), 4, '0') AS sequence_id FROM nation")
def sequence_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.sequence_ids(table(spark, sf, "nation"), "region_", ["n_regionkey"], [F.col("n_name")]).select("n_nationkey", "sequence_id")


@define("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS number FROM lineitem")
def numbered_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All rows in one order, numbered without a task that holds them all."""
    out = ranking.numbered(table(spark, sf, "lineitem"), [F.col("l_extendedprice").desc(), *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))])
    return out.select("l_orderkey", "l_linenumber", "number")


@define("SELECT s_nationkey, round(m, 4) AS mean_score, dense_rank() OVER (ORDER BY m DESC) AS rank FROM (SELECT s_nationkey, avg(s_acctbal) AS m FROM supplier GROUP BY 1)")
def ranking_by_mean(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.mean_ranking(table(spark, sf, "supplier"), "s_nationkey", "s_acctbal").withColumn("mean_score", F.round("mean_score", 4))


@define("SELECT l_orderkey, l_linenumber, l_partkey, round(lead(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - l_extendedprice, 4) AS gap FROM lineitem")
def adjacent_gaps(spark: SparkSession, sf: str) -> DataFrame:
    out = ranking.adjacent_gaps(table(spark, sf, "lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_extendedprice")], "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("gap", 4).alias("gap"))


@define(
    "WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice AS v, row_number() OVER w AS i, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_custkey, o_orderkey, greatest(v, coalesce(b, v)) AS best, b IS NULL OR v > b AS is_record, i - max(CASE WHEN b IS NULL OR v > b THEN i END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS stale FROM o"
)
def running_best(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.running_best(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderkey")], "o_totalprice").select("o_custkey", "o_orderkey", "best", "is_record", F.col("stale").cast("bigint").alias("stale"))


@define("SELECT 'price' AS field, count(*) FILTER (l.p IS NOT DISTINCT FROM r.p) AS matches, count(*) FILTER (l.p IS DISTINCT FROM r.p) AS mismatches FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS p FROM lineitem) l JOIN (SELECT l_orderkey, l_linenumber, CASE l_partkey % 7 WHEN 0 THEN l_extendedprice + 1 WHEN 1 THEN NULL ELSE l_extendedprice END AS p FROM lineitem) r USING (l_orderkey, l_linenumber)")
def field_equality_audit(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"))
    k = F.col("l_partkey") % 7
    changed = li.withColumn("price", F.when(k == 0, F.col("price") + 1).when(k != 1, F.col("price")))
    return audit.field_mismatches(li, changed, ["l_orderkey", "l_linenumber"], ["price"])


@define("SELECT n_regionkey, n_mod, coalesce(n, 0) AS n FROM (SELECT DISTINCT n_regionkey FROM nation) CROSS JOIN (SELECT DISTINCT n_nationkey % 5 AS n_mod FROM nation) LEFT JOIN (SELECT n_regionkey, n_nationkey % 5 AS n_mod, count(*) AS n FROM nation GROUP BY ALL) USING (n_regionkey, n_mod) WHERE coalesce(n, 0) <> 1")
def balance_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.balance(table(spark, sf, "nation").withColumn("n_mod", F.col("n_nationkey") % 5), ["n_regionkey", "n_mod"], 1)


@define("SELECT o_custkey AS key, list_sort(list(DISTINCT o_orderstatus)) AS splits FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def split_disjointness(spark: SparkSession, sf: str) -> DataFrame:
    return audit.split_overlaps(table(spark, sf, "orders").withColumnRenamed("o_custkey", "key"), "key", "o_orderstatus")


@define("SELECT sha256(coalesce(text, '')) AS content_hash, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_hash(spark: SparkSession, sf: str) -> DataFrame:
    return audit.exact_duplicates(table(spark, sf, "documents"), F.coalesce("text", F.lit("")))


@define("SELECT key_json, count(*) AS n, list_sort(list(DISTINCT label)) AS splits FROM (SELECT '{\"k0\":[' || array_to_string(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) / 0.05) AS BIGINT)), ',') || ']}' AS key_json, label FROM embeddings) GROUP BY key_json HAVING count(DISTINCT label) > 1")
def near_duplicate_quantized(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.transform("embedding", lambda x: F.floor(x.cast("double") / 0.05))
    return audit.quantized_duplicates(table(spark, sf, "embeddings"), [cells], "label")


@define("SELECT unnest(['price is positive', 'discount below tax']) AS invariant, unnest([count(*) FILTER (NOT coalesce(l_extendedprice > 0, false)), count(*) FILTER (NOT coalesce(l_discount < l_tax, false))]) AS broken FROM lineitem")
def invariant_report(spark: SparkSession, sf: str) -> DataFrame:
    return audit.invariant_report(table(spark, sf, "lineitem"), {"price is positive": F.col("l_extendedprice") > 0, "discount below tax": F.col("l_discount") < F.col("l_tax")})


@define("SELECT l_returnflag, " + ", ".join(f"max(CASE WHEN l_linestatus = '{s}' THEN printf('%.4f', m) END) AS \"{s}\"" for s in "FO") + " FROM (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def matrix_report(spark: SparkSession, sf: str) -> DataFrame:
    means = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("m"))
    return matrix(means, "l_returnflag", "l_linestatus", "m", ["F", "O"], 4)
