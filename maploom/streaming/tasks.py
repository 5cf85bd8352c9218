"""States of running tasks, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maploom.operators.access import progress


def states(log: DataFrame) -> DataFrame:
    """Of a streaming log (task_id, ts, state, current, total) the last state of each task and its percentage.

    For output modes update and complete; what is kept for a task is one row.
    """
    last = F.max_by(F.struct("ts", "state", "current", "total"), "ts").alias("s")
    rows = log.groupBy("task_id").agg(last).select("task_id", "s.*")
    return rows.select("task_id", "ts", "state", progress(F.col("state"), F.col("current"), F.col("total")).alias("percent"))


def first_reports(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (task_id, state) once, the earliest that arrives; repeats later than late are taken for new ones."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["task_id", "state"])
