"""Mixing sources to target weights: repetition rates and hash-seeded Bernoulli copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import hot_join, saved

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Plans of at most so many bytes are broadcast; larger ones meet the documents in a salted join.
BROADCAST_BYTES = 8 << 20


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and \\x09-\\x0D; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: int, *of: Column) -> Column:
    """A number in [0, 1) that follows from the values and the seed: 32 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("null")) for c in of))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def key_of(source: Column) -> Column:
    """The source as a key that is never null: null is a source like others."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Each source's target from its size: (source, source_size, target).

    The sources by code point, null last, have the weights in turn and share
    ``share`` of all sizes by weight; a target stops at ``most`` times its source's
    size and the excess is shared again. Sources in order of cap over weight fill
    up one after the other, so the sources that stop are a prefix of that order:
    running sums give the level at which the rest stay. The table has one row for
    each source, which is what the two unpartitioned windows order.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    out = sizes.withColumn("weight", w).withColumn("cap", cap)
    out = out.withColumn("left_share", F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    out = out.withColumn("left_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("open", F.col("left_share") * F.col("weight") <= F.col("cap") * F.col("left_weight"))
    # the first open source fixes the level of all that follow
    level = F.first(F.when(F.col("open"), F.col("left_share") / F.col("left_weight")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    opened = F.max(F.col("open").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    out = out.withColumn("level", level).withColumn("opened", opened)
    return out.select("source", "source_size", F.when(F.col("opened"), F.col("level") * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 17, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the document).

    A source's rate is its target over its size; a document is taken floor(rate)
    times and once more with the remaining probability, decided by a hash of seed,
    id and text, so reruns agree. copies is at most ``most``. A null or wordless text
    has size 0 and its source's rate; a source of no words has target 0 and copies
    0. Equal rows share their draw. docs' columns stay; those named like new ones
    are replaced; an empty table stays empty. The plan has a row for each source. It is written first, and
    broadcast if it has at most ``broadcast_bytes``, so texts aren't shuffled; a
    larger one is joined with the rows of large sources spread over salts.
    """
    new = ["size", "source_size", "target", "copies"]
    sized = docs.drop(*(c for c in new if c in docs.columns and c not in (id_col, text_col, source_col))).withColumn("size", word_count(F.col(text_col)))
    sources = saved(sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    plan = targets(sources.drop("n"), weights, share, most)
    rows = sized.select(F.struct("*").alias("row"), key_of(F.col(source_col)).alias("key"), uniform(seed, F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("draw"))
    plan = plan.select(key_of(F.col("source")).alias("key"), "source_size", "target")
    if sources.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + 32), F.lit(0))).first()[0] <= broadcast_bytes:
        out = rows.join(F.broadcast(plan), "key", "left")
    else:
        counted = saved(plan.join(sources.select(key_of(F.col("source")).alias("key"), "n"), "key"), "plan")
        out = hot_join(rows.withColumn("id", F.col(f"row.`{id_col}`")), counted, ["key"], "n", ["id", "draw"], "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("long")
    return out.select("row.*", "source_size", "target", copies.alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """A row for each copy of each document, numbered by ``copy`` from 0 (a column of that name is replaced); documents of no copies have none."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
