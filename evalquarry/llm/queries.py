"""The operators' queries: each applies one to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .filter_audit import filter_audit
from .language import identify
from .mixing import mix
from .multi_index import nearest
from .near_dedup import near_duplicates
from .periodic_runs import collapse_runs
from .quality import score as quality_score
from .quality_rules import STOP_WORDS, apply_rules, split_words
from .shared import fresh_path, saved
from .substring_dedup import substring_dedup, word_text
from .suffix_dedup import suffix_dedup
from .toxicity import score as toxicity_score
from .warc import checked, read_archives, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_shingles")


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(word_text(F.col("text")), 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = saved(write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc")), "archives")
    out = checked(read_archives(spark, archives))
    return out.select(F.expr("try_cast(record_id AS BIGINT)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stretches(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) of which those with a CRC-32 of the id that ends in 0 go through their words of a stretch again and again.

    A null id has no CRC-32: its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.withColumn("h", h).withColumn("words", F.when(F.col("h") % 10 == 0, split_words(F.coalesce("text", F.lit("")))))
    g = F.floor(F.col("h") / 10)
    chosen = chosen.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    chosen = chosen.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    place = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    again = F.array_join(F.transform(place, lambda i: F.get("words", i)), " ")
    return chosen.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collapse_runs(stretches(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "runs", "collapsed")
    # the runs are ordered by start, then period: of the longest ones the first is asked for
    longest = F.filter("runs", lambda r: r["length"] == F.array_max(F.transform("runs", lambda x: x["length"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.withColumn("best", F.get(longest, F.lit(0)))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_multi_index_hashing, op3_decontaminate, op4_substring_dedup, op5_warc, op6_quality, op7_toxicity, op8_suffix_array_dedup, op9_language_id, op10_mix_sources, op11_filter_interaction_audit, op12_quality_rules, op13_periodic_runs)
}

ORACLES: dict[str, str] = {
    "op3_decontaminate": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM bs),
ks AS (SELECT DISTINCT k FROM bg),
ds AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM dw, ks WHERE len(w) >= k),
dg AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM ds),
hits AS (SELECT dg.doc_id, dg.k, dg.s, bg.item_id FROM dg JOIN bg ON dg.k = bg.k AND dg.g = bg.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(list_sort(items), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw ON dw.doc_id = hw.doc_id LEFT JOIN hi ON dw.doc_id = hi.doc_id
""",
    "op4_substring_dedup": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ws AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM dw WHERE len(w) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM ws) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM later) GROUP BY doc_id),
kept AS (SELECT t.doc_id, string_agg(t.x, ' ' ORDER BY t.p) AS text FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM dw) t LEFT JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) g ON t.doc_id = g.doc_id AND t.p = g.p WHERE g.p IS NULL GROUP BY t.doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM dw LEFT JOIN gone ON dw.doc_id = gone.doc_id LEFT JOIN kept ON dw.doc_id = kept.doc_id
""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to
FROM q
""",
    "op10_mix_sources": r"""
WITH d AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, source_size * 2 AS cap FROM s),
o AS (SELECT *, (SELECT sum(source_size) FROM s) * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_share,
      sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight, CAST(cap AS DOUBLE) / weight AS ratio FROM w),
lv AS (SELECT ratio, CAST(left_share AS DOUBLE) / CAST(left_weight AS DOUBLE) AS level FROM o WHERE left_share * weight <= cap * left_weight ORDER BY ratio LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN o.ratio >= lv.ratio THEN lv.level * weight ELSE CAST(cap AS DOUBLE) END AS target FROM o LEFT JOIN lv ON true),
r AS (SELECT d.doc_id, d.text, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN CAST(('0x' || substr(md5('17:' || doc_id || ':' || md5(coalesce(text, ''))), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
""",
    "op11_filter_interaction_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT)
      + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(d.doc_id > first, false) AS INT) AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, 1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1) AS own, coalesce(list_sum(list_transform(range(1, step), lambda k: 1 << (instr('ABCDE', substr(filter_order, k, 1)) - 1))), 0)::INT AS before
      FROM (SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM o)),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
""",
    "op12_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT r, s, md5(array_to_string(w[s:s + 7], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS s FROM d WHERE len(w) > 8)),
p AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + 8)) AS p FROM (SELECT r, s, count(*) OVER (PARTITION BY r, g) AS k FROM g) WHERE k > 1) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
      length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, len(list_filter(w, lambda x: lower(rtrim(x, '.,;:!?')) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS stops, len(ls) AS n_lines,
      len(list_filter(ls, lambda x: x[1] IN ('-', '*', '•'))) AS bullets, len(list_filter(ls, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS cut
      FROM d LEFT JOIN p ON d.r = p.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1400 * n_words AND 100 * n_symbols <= 10 * n_words AND 100 * capitals <= 30 * word_chars AND 100 * stops >= 6 * n_words
       AND 100 * n_dup_lines <= 30 * n_lines AND 100 * bullets <= 90 * n_lines AND 100 * cut <= 30 * n_lines AS kept
FROM b
""",
    "op13_periodic_runs": r"""
WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
      xor(CAST(4294967295 AS BIGINT), list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: list_concat([CAST(ascii(x) AS BIGINT)], [CAST(256 AS BIGINT) FOR i IN range(8)])))),
          lambda h, x: CASE WHEN x < 256 THEN xor(h, x) WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END)) AS h FROM documents),
a AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM c),
q AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM q),
g AS (SELECT r, s, md5(array_to_string(w[s:s + 5], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 4)) AS s FROM d WHERE len(w) >= 12)),
e AS (SELECT x.r, x.s, y.s - x.s AS q FROM g x JOIN g y ON x.r = y.r AND x.g = y.g AND x.s < y.s),
i AS (SELECT r, q, min(s) AS s, max(s) + 5 AS e FROM (SELECT *, s - row_number() OVER (PARTITION BY r, q ORDER BY s) AS island FROM e) GROUP BY r, q, island),
u AS (SELECT r, s - 1 AS start, e - s + 1 + q AS length, min(q) AS period FROM i WHERE e - s + 1 >= q AND e - s + 1 + q >= 12 GROUP BY ALL),
v AS (SELECT r, start, max(length) AS length, period FROM (SELECT r, start, length, min(period) AS period FROM u GROUP BY r, start, length) GROUP BY r, start, period),
o AS (SELECT r, count(*) AS n_runs, first({'start': start, 'length': length, 'period': period} ORDER BY length DESC, start, period) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM v GROUP BY r),
z AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS k FROM v),
k AS (SELECT t.r, string_agg(t.x, ' ' ORDER BY t.k) AS text FROM (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS k FROM d) t LEFT JOIN z ON t.r = z.r AND t.k = z.k WHERE z.k IS NULL GROUP BY t.r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
       CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM d LEFT JOIN o ON d.r = o.r LEFT JOIN k ON d.r = k.r
""",
}
