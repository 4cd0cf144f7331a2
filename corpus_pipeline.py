"""A training corpus from documents, in five stages, each one of the library's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.llm import near_dedup
from evalquarry.llm.decontaminate import decontaminate
from evalquarry.llm.mixing import emit, mix
from evalquarry.llm.quality import keep_good
from evalquarry.llm.shared import saved
from evalquarry.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of statistics doesn't reject: those with a score of 0.5 or more, in docs' columns.

    Null and empty texts have statistics of zero and are scored like others; a null id is no
    label's. Repeated rows stay or go alike; no documents give none. Labels teach
    only where the split doesn't hold them out; without labels of both kinds the
    score is the labels' share, and without any all documents stay.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id (a null id is the least).

    Rows of equal id and text are one document, of which one stays. Null texts are
    classes of their own, and so are empty ones: they stay, one for each id. Of a tie, an id with
    several texts in one class, that of the least hash stays. No documents give none.
    """
    return near_dedup.keep_one(docs).select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 20-word windows that start earlier: in a smaller id, or before in the same text.

    A text that loses words is its other words joined by spaces, and n_chars its new
    length; other texts, nulls and empties too, stay as they are. Of repeated
    rows one counts as the earlier: it keeps its words. A null id comes first. No documents give none.
    """
    out = substring_dedup(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that occur in a 10-word window of a benchmark item (all words of a shorter item).

    n_chars follows where words go. Documents without a hit, nulls and empties stay as
    they are; repeated rows lose the same words; an empty benchmark hits nothing, and
    no documents give none. An item that repeats, or has a null id or text, is no special case.
    """
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    out = out.withColumn("n_chars", F.when(F.col("contaminated"), F.char_length("clean_text").cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.when(F.col("contaminated"), F.col("clean_text")).otherwise(F.col("text"))).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of each document that the mix takes, numbered by copy from 0.

    Sources share 150 % of all words by weights 5, 2 and 1 in turn, none more than twice
    its own; a null source is one like others. A document is taken floor(rate) times and once
    more by its hash, so reruns agree; equal rows share their draw. Texts without words have size 0
    and their source's rate; those of a source without words aren't taken. No documents give none.
    """
    return emit(mix(docs)).select(*COLUMNS, "copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixture),
]

#: SQL can express neither the classifier nor the near duplicates; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
