"""Tables in the folder that driver and executors share, and other small helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local folder of our own only where that is unset and the master is local (tests)."""
    if set_dir := spark.conf.get("spark.checkpoint.dir", None):
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = f"file://{tempfile.mkdtemp(prefix='evalquarry-')}"
    return _OWN["dir"]


#: Bytes of an Arrow batch, at most, between Spark and Python.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Limit the session's Arrow batches to BATCH_BYTES: rows are whole texts, so a number of rows bounds no memory.

    The setting stays with the session, as the returned DataFrames read it when they run; a smaller one is left alone.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not re.fullmatch(r"\d+b?", now := spark.conf.get(key)) or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a written table: they are computed once and outlive lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


_PATHS: dict[int, tuple[DataFrame, str]] = {}


def forget(*tables: DataFrame) -> None:
    """Delete saved tables that nothing will read again: what followed from them is saved itself."""
    for table in tables:
        _, path = _PATHS.pop(id(table))
        target = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def packed_rest(docs: DataFrame, *used: str) -> Column:
    """docs' columns other than those used, as one struct that passes through a job."""
    others = [c for c in docs.columns if c not in used]
    return (F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.struct(F.lit(0).alias("_none"))).alias("rest")


def unpacked_rest(docs: DataFrame, *used: str) -> list[Column]:
    return [F.col(f"rest.`{c}`") for c in docs.columns if c not in used]


def schema_of(df: DataFrame, names: list[str], more: str) -> T.StructType:
    """The schema of some columns of df, and more columns."""
    return T.StructType([df.schema[n] for n in names] + T._parse_datatype_string(more).fields)


#: A key is hot if it has more than one in so many of all rows: there are fewer such keys than this.
HOT_SHARE = 1000
SALTS = 64


def hot_join(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, spread: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a table that has one row and a number of rows (``weight``) for each key.

    Keys of more than a HOT_SHARE-th of all rows are spread over SALTS: fewer than
    HOT_SHARE keys can be hot, whatever the size of the data, so their list may be
    broadcast. ``spread`` names columns of rows that tell a hot key's rows apart.
    In a left join, rows with a null key are spread in the same way.
    keyed should be a written table; it is read three times.
    """
    total = keyed.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = F.broadcast(keyed.filter(F.col(weight) * HOT_SHARE > total).select(*on, F.lit(True).alias("_hot")))
    spreads = F.coalesce("_hot", F.lit(False))
    if how == "left":  # rows with a null key match nothing and stay: any salt will do
        spreads = reduce(Column.__or__, (F.col(c).isNull() for c in on), spreads)
    salt = F.when(spreads, F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, on, "left").withColumn("_salt", salt).drop("_hot")
    right = keyed.join(hot, on, "left").withColumn("_salt", F.explode(salts)).drop("_hot", weight)
    return left.join(right, [*on, "_salt"], how).drop("_salt")
