"""Labelled training rows and the split that holds a third of the documents out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most: those of least hash of their id.
SAMPLE = 20_000


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(labels: DataFrame, label_col: str, id_col: str = "doc_id", rows: int = SAMPLE) -> DataFrame:
    """At most ``rows`` training ids with their label: (id, label).

    Null ids and labels are left out; an id with several labels has the greatest.
    """
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    one = given.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    return one.orderBy(F.xxhash64("id"), "id").limit(rows)
