"""The evaluation of a log from scan to comparison, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.audit import completeness
from ..operators.metrics import grouped_levels, wide_metrics
from ..operators.paired import mcnemar, with_baseline
from ..operators.ranking import latest


def evaluate(log: DataFrame, keys: Sequence[str], order: Sequence[Column], flag: Column) -> DataFrame:
    """The last record of each key, with ``correct``."""
    return latest(log, keys, order).withColumn("correct", flag)


def condition_metrics(scored: DataFrame, unit: Sequence[str], condition: str, baseline: str) -> DataFrame:
    """Each condition against the baseline in the same unit: accuracies, discordant counts, exact p."""
    paired = with_baseline(scored, unit, condition, baseline, "correct")
    return mcnemar(paired.filter(F.col(condition) != baseline), F.col("correct"), F.col("baseline"), [condition])


def report(scored: DataFrame, condition: str, family: str, families: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Accuracies by all levels of condition and family in one pass, and conditions by families side by side."""
    aggs = (F.count("*").alias("n"), F.count_if(F.col("correct")).alias("correct_n"), F.avg(F.col("correct").cast("int")).alias("accuracy"))
    return grouped_levels(scored, [[], [condition], [family], [condition, family]], *aggs), wide_metrics(scored, [condition], family, families, F.col("correct"))


def checked(planned: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """observed, once every planned key and no other is there; raises otherwise."""
    if rows := completeness(planned, observed, keys).limit(3).collect():
        raise ValueError(f"incomplete or extra: {rows}")
    return observed


def asked_rows(todo: DataFrame, keys: Sequence[str], call: Callable[[pd.DataFrame], list[str | None]], valid: Callable[[str], bool] | None = None) -> DataFrame:
    """One request for each row: the rows with response (null unless it is valid) and error.

    ``call`` answers a batch. If it fails, or gives another number of answers, the
    batch's rows are asked one by one, so that a row that fails takes no other with it.
    An answer that isn't ``valid`` is kept in the error and not in response.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema)

    def checked_answer(answer: str | None) -> tuple[str | None, str | None]:
        if answer is None:
            return None, "no answer"
        try:
            return (answer, None) if valid is None or valid(answer) else (None, f"invalid: {answer}")
        except Exception as e:  # noqa: BLE001  a check that fails says no
            return None, f"invalid: {answer} ({e})"

    def single(row: pd.DataFrame) -> tuple[str | None, str | None]:
        try:
            (answer,) = call(row)
        except Exception as e:  # noqa: BLE001  the caller's client may fail in any way
            return None, str(e) or type(e).__name__
        return checked_answer(answer)

    def answers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.reset_index(drop=True)
            try:
                given = list(call(part))
                if len(given) != len(part):
                    raise ValueError(f"{len(given)} answers to {len(part)} rows")
                pairs = [checked_answer(a) for a in given]
            except Exception:  # noqa: BLE001
                pairs = [single(part.iloc[i : i + 1].reset_index(drop=True)) for i in range(len(part))]
            yield part.assign(response=[r for r, _ in pairs], error=[e for _, e in pairs])

    return todo.mapInPandas(answers, f"{fields}, response string, error string")


def run_pending(schedule: DataFrame, log: str, keys: Sequence[str], call: Callable[[pd.DataFrame], list[str | None]], valid: Callable[[str], bool] | None = None, attempts: int = 3, batch: int = 64) -> DataFrame:
    """Ask for every scheduled row until it has a valid response or ``attempts`` are used up; returns the last record of each row.

    ``log`` is a folder of records, which grows by rounds. A round takes the
    scheduled rows that an anti-join says have neither a valid response nor
    all their attempts in the log, asks for them in batches of ``batch`` rows and
    appends what came, valid or not, with the attempt's number. Spark's commit
    publishes a round's records whole, and a task writes at most ``batch`` rows' answers at a time, so a
    lost executor repeats its own tasks. A run that was killed goes on from the
    rounds that are in the log; rows that have a valid response aren't asked again.
    keys name a scheduled row; repeated rows of a key are asked once.
    """
    spark = schedule.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in schedule.schema}
    record = f"{', '.join(f'`{n}` {k}' for n, k in kinds.items())}, response string, error string, attempt int"
    empty = spark.createDataFrame([], record)
    unique = schedule.dropDuplicates(list(keys))

    def records() -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(log)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return spark.read.schema(record).parquet(log) if there else empty

    for _ in range(attempts):
        state = records().groupBy(*keys).agg(F.max(F.col("response").isNotNull().cast("int")).alias("_done"), F.max("attempt").alias("_last"))
        over = state.filter((F.col("_done") == 1) | (F.col("_last") >= attempts)).select(*keys)
        todo = unique.join(over, list(keys), "left_anti").select(*schedule.columns)
        if todo.isEmpty():
            break
        turn = todo.join(state.select(*keys, "_last"), list(keys), "left").select(*schedule.columns, (F.coalesce("_last", F.lit(0)) + 1).cast("int").alias("attempt"))
        asked_again = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch)}
        before = {k: spark.conf.get(k) for k in asked_again}
        try:
            for k, v in asked_again.items():
                spark.conf.set(k, v)
            asked_rows(turn, keys, call, valid).select(*schedule.columns, "response", "error", "attempt").write.mode("append").parquet(log)
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
    return latest(records().join(unique.select(*keys), list(keys), "left_semi"), keys, [F.col("response").isNotNull(), F.col("attempt")])
