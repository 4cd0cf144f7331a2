"""Tables that are computed once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept by a reliable checkpoint: what follows reads the same rows after a lost executor too.

    The folder is the session's spark.checkpoint.dir; one of our own only where that is unset and the master is local (tests).
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='evalquarry-')}")
    return df.checkpoint()


def spread(df: DataFrame, *by: str, rows: int | None = None) -> DataFrame:
    """df in as many partitions as shuffles have, for rows that are few bytes and much work: by bytes alone Spark would put small ones into one task.

    With ``rows`` in more, of about so many rows each, so that a task's memory doesn't grow
    with the table; df is counted for that. What follows by ``by`` needs no other shuffle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n if rows is None else max(n, -(-df.count() // rows)), *by)
