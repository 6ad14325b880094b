"""Time, shuffle and spill of every stage of every query, from Spark's event log.

``named`` marks the jobs of a query; ``stage_times`` reads the log that Spark writes anyway
(``spark.eventLog.enabled``) as a table.  Nothing listens while queries run, no page or server is
asked, and the log is read like any other text: one scan, filtered by event, one aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The local property that Spark puts into the log with every job.
GROUP = "spark.jobGroup.id"
#: Session settings under which ``stage_times`` can read the log while the application runs.
LOG_SETTINGS = {
    "spark.eventLog.enabled": "true",
    "spark.eventLog.rolling.enabled": "false",
    "spark.eventLog.compress": "false",
    "spark.eventLog.buffer.kb": "1k",
}

_JOB = f"`Job ID` int, `Stage IDs` array<int>, Properties struct<`{GROUP}`: string>"
_TASK = """`Stage ID` int, `Stage Attempt ID` int,
  `Task End Reason` struct<Reason: string>,
  `Task Info` struct<`Launch Time`: long, `Finish Time`: long>,
  `Task Metrics` struct<
    `Executor Run Time`: long, `Executor CPU Time`: long, `JVM GC Time`: long,
    `Disk Bytes Spilled`: long,
    `Shuffle Read Metrics`: struct<`Remote Bytes Read`: long, `Local Bytes Read`: long>,
    `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: long>,
    `Input Metrics`: struct<`Bytes Read`: long, `Records Read`: long>>"""


@contextmanager
def named(spark: SparkSession, query: str) -> Iterator[None]:
    """Jobs started inside, in this thread or one that inherits from it, belong to ``query``."""
    context = spark.sparkContext
    before = context.getLocalProperty(GROUP)
    context.setLocalProperty(GROUP, query)
    try:
        yield
    finally:
        context.setLocalProperty(GROUP, before)


def event_log(spark: SparkSession) -> str:
    """The folder of this application's log."""
    folder = spark.conf.get("spark.eventLog.dir", None)
    if folder is None or spark.conf.get("spark.eventLog.enabled", "false") != "true":
        raise ValueError("start the session with LOG_SETTINGS and spark.eventLog.dir")
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}*"


def stage_times(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(query, stage, tasks, failed, seconds, task_seconds, cpu_seconds, gc_seconds, longest_task, read_mb,
    read_rows, shuffle_read_mb, shuffle_write_mb, spill_mb)`` from the event log at ``path``.

    ``seconds`` runs from a stage's first task to its last; ``task_seconds`` adds the tasks up.  A stage
    counts for the query of its first job, which is the one that ran it; tasks of all attempts count.
    Jobs outside ``named`` have a null query.  A cut-off last line, as in a running application's log,
    is left out.
    """
    lines = spark.read.text(path or event_log(spark))
    event = F.get_json_object("value", "$.Event")
    starts = lines.filter(event == "SparkListenerJobStart").select(F.from_json("value", _JOB).alias("job"))
    owners = starts.select(F.explode(F.col("job.`Stage IDs`")).alias("stage"), "job.*")
    owners = owners.groupBy("stage").agg(F.min_by(F.col(f"Properties.`{GROUP}`"), "Job ID").alias("query"))
    ends = lines.filter(event == "SparkListenerTaskEnd").select(F.from_json("value", _TASK).alias("task"))
    ends = ends.filter("task.`Stage ID` is not null").select("task.*")
    metrics, info = F.col("Task Metrics"), F.col("Task Info")

    def total(column, unit: float):
        return F.round(F.coalesce(F.sum(column), F.lit(0)) / unit, 3)

    shuffled = metrics["Shuffle Read Metrics"]
    by_stage = ends.groupBy(F.col("Stage ID").alias("at")).agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(F.col("Task End Reason.Reason") != "Success").alias("failed"),
        F.round((F.max(info["Finish Time"]) - F.min(info["Launch Time"])) / 1e3, 3).alias("seconds"),
        total(metrics["Executor Run Time"], 1e3).alias("task_seconds"),
        total(metrics["Executor CPU Time"], 1e9).alias("cpu_seconds"),
        total(metrics["JVM GC Time"], 1e3).alias("gc_seconds"),
        F.round(F.max(info["Finish Time"] - info["Launch Time"]) / 1e3, 3).alias("longest_task"),
        total(metrics["Input Metrics"]["Bytes Read"], 1e6).alias("read_mb"),
        F.coalesce(F.sum(metrics["Input Metrics"]["Records Read"]), F.lit(0)).alias("read_rows"),
        total(shuffled["Remote Bytes Read"] + shuffled["Local Bytes Read"], 1e6).alias("shuffle_read_mb"),
        total(metrics["Shuffle Write Metrics"]["Shuffle Bytes Written"], 1e6).alias("shuffle_write_mb"),
        total(metrics["Disk Bytes Spilled"], 1e6).alias("spill_mb"),
    )
    rest = [c for c in by_stage.columns if c != "at"]
    return by_stage.join(owners, F.col("at") == F.col("stage")).select("query", "stage", *rest)


def query_times(stages: DataFrame, longest: int = 3) -> DataFrame:
    """One row per query of :func:`stage_times`: sums, and its ``longest`` stages ``(stage, seconds)``."""
    by_time = F.sort_array(F.collect_list(F.struct("seconds", "stage")), asc=False)
    return stages.groupBy("query").agg(
        F.count(F.lit(1)).alias("stages"),
        F.sum("tasks").alias("tasks"),
        *[F.round(F.sum(c), 3).alias(c) for c in ("task_seconds", "cpu_seconds", "shuffle_write_mb", "spill_mb")],
        F.slice(by_time, 1, longest).alias("longest"),
    )
