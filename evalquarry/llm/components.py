"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the least node of its component.

    Each round replaces links by links to the least neighbour; the least is an
    aggregation with map-side combine, so a node with very many links is no
    burden. Rounds are written tables: lineage stays short and no executor holds
    state. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    mark = F.struct(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x"))
    before = edges.agg(mark.alias("m")).first()[0]
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        last, edges = edges, saved(small, "links")
        forget(last)
        after = edges.agg(mark.alias("m")).first()[0]
        if after == before:
            break
        before = after
    # a fixpoint is a star around the least node of each component
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
