"""Session settings and the shared folder that lineage cuts are written to."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


TABLES = "riskframe.tables"


def local_session(cores: str | int = "*", app: str = "riskframe", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster that
    folder would live on one machine and vanish with it.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    one_machine = re.fullmatch(r"local(\[.*\])?", context.master)
    if configured is None and current is None and not one_machine:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    root = configured or current or tempfile.mkdtemp(prefix="riskframe-")
    if current is None:
        context.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    root = spark.conf.get(TABLES, None) or shared_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def own_tables(spark: SparkSession, folder: str | None = None) -> Iterator[str]:
    """Store tables below ``folder`` (or a new one in the shared folder) and drop it at the end.

    What was built inside may be read inside only; write or collect what is to stay.
    """
    folder = folder or shared_path(spark, "tables")
    before = spark.conf.get(TABLES, None)
    spark.conf.set(TABLES, folder)
    try:
        yield folder
    finally:
        if before is None:
            spark.conf.unset(TABLES)
        else:
            spark.conf.set(TABLES, before)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialised(df: DataFrame, rows_per_file: int | None = None) -> DataFrame:
    """Store ``df`` once in the shared folder, so that its readers do not recompute it.

    ``rows_per_file`` bounds the rows of a file, and so those of a reader's split, however well they
    compress: a split holds whole files up to ``spark.sql.files.maxPartitionBytes``, each of them
    counted as ``spark.sql.files.openCostInBytes`` more than it has.

    A Parquet table rather than ``checkpoint()``: readers scan only the columns
    they need, and a checkpoint derives the constraints of its whole plan,
    which takes exponentially long below an assembled vector of many columns.
    """
    spark = df.sparkSession
    path = shared_path(spark, "table")
    writer = df.write if rows_per_file is None else df.write.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
