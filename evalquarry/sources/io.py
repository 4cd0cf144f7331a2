"""Readers and writers for logs, documents and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Whole files as one document each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True, missing_ok: bool = False) -> DataFrame:
    """A log of one record per line; blank lines are skipped.

    strict: a malformed line is an error that names its file and line. Otherwise such lines come back with their
    text in _corrupt_record. missing_ok: a path that isn't there is an empty table.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    if not strict:
        return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    bad = F.raise_error(F.concat(F.lit("malformed JSON at "), F.col("file"), F.lit(":"), F.col("line").cast("string")))
    checked = lines.withColumn("p", parsed).withColumn("p", F.when(F.col("p._corrupt_record").isNull(), F.col("p")).otherwise(bad.cast(wide)))
    return checked.select(*(F.col(f"p.`{f.name}`") for f in schema.fields))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files with their file and number (from 1): file, line, value.

    Spark reads a file in blocks, each in order within one task: a line's number is
    its place in the block plus the lines of the file's earlier blocks, a table of
    one row for each block.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.withColumn("before", before).select("file", "block", "first", "before")
    return lines.join(offsets, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def quarantined(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines) of a log that wasn't read strictly."""
    raw = F.col("_corrupt_record")
    return log.filter(raw.isNull()).drop("_corrupt_record"), log.filter(raw.isNotNull()).select("_corrupt_record")


def read_stems(spark: SparkSession, glob: str, schema: T.StructType | str) -> DataFrame:
    """JSON documents of a folder, keyed by their file's stem."""
    name = F.col("_metadata.file_name")
    return spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("stem", F.regexp_replace(name, r"\.[^.]*$", ""))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, size, sha256 and, for .jsonl files, records of every file below a folder; files of any size, read in pieces."""
    return spans.manifest(spark, root)


def read_images(spark: SparkSession, glob: str) -> DataFrame:
    """Image files with their pixels, through Spark's own decoder."""
    return spark.read.format("image").load(glob).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


def read_arrays(spark: SparkSession, glob: str) -> DataFrame:
    """Vectors of .npy and .npz files (rows of 2-D arrays): path, name (of an archive's array, else null), row, values. Arrays of any size, read by spans of rows."""
    return spans.arrays(spark, glob)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """Lines of a log; Spark's commit protocol publishes them whole."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, fields: Sequence[str] | None = None, allow_empty: bool = True, single: bool = False) -> None:
    """CSV with a header: all columns, or those named (others are left out, absent ones are null). allow_empty: no rows are no error.

    A file for each task; ``single`` writes a small report as one file, by one task.
    """
    if fields:
        df = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields))
    if not allow_empty and df.isEmpty():
        raise ValueError("no rows to write")
    flat = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, T.ArrayType | T.MapType | T.StructType) else F.col(c) for c in df.columns]
    flattened = df.select(*flat)
    (flattened.coalesce(1) if single else flattened).write.mode("overwrite").option("header", True).csv(path)


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of tables whose columns differ; what one lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def matrix(pairs: DataFrame, row: str, column: str, value: str, domain: Sequence[object], digits: int = 10) -> DataFrame:
    """A row for each label and a formatted value for each label of the domain."""
    cell = lambda d: F.first(F.when(F.col(column) == d, F.format_string(f"%.{digits}f", F.col(value))), ignorenulls=True).alias(str(d))
    return pairs.groupBy(row).agg(*map(cell, domain))


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).json(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table, for reading; more than ``most`` rows are an error, as none may be left out unseen."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in rows)]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines)


def content_cached(df: DataFrame, key: Column, compute) -> DataFrame:
    """compute(distinct inputs) joined back to all rows: equal inputs are computed once. Rows need a column for compute's inputs."""
    keyed = df.withColumn("_key", F.sha2(key, 256))
    once = compute(keyed.dropDuplicates(["_key"]))
    new = [c for c in once.columns if c not in keyed.columns]
    return keyed.join(once.select("_key", *new), "_key").drop("_key")


def write_document(df: DataFrame, path: str, sort_keys: bool = False, most: int = 100_000) -> None:
    """A report of at most ``most`` rows as one JSON document, an array of objects laid out for reading; more rows are an error.

    One row holds the document, so it is for reports; a table goes to write_jsonl.
    """
    if (n := df.limit(most + 1).count()) > most:
        raise ValueError(f"more than {most} rows are no report")
    names = sorted(df.columns) if sort_keys else df.columns
    whole = df.agg(F.to_json(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in names))), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")) if n else df.sparkSession.createDataFrame([("[]",)], "value string")
    whole.coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
