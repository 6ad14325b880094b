"""Reading and writing transaction tables on any Hadoop file system."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.session import materialised
from riskframe.sources.schema import TXN

#: Text takes several times the room of Parquet, so it is compressed; a compressed file is read by one
#: task, so its rows are bounded.
CSV_WRITE = {"header": True, "compression": "gzip", "maxRecordsPerFile": 250_000}


def read_transactions(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    schema: T.StructType | None = TXN,
    malformed: str = "PERMISSIVE",
) -> DataFrame:
    """Scan a table from a local path or any Hadoop URI (``hdfs://``, ...).

    With a schema no pass over the data is spent on inference, and a CSV header
    that disagrees with the schema is an error rather than shifted columns.
    ``schema=None`` asks for inference.  ``malformed`` is Spark's CSV ``mode``.
    """
    if fmt == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(*([path] if isinstance(path, str) else path))
    if fmt != "csv":
        raise ValueError(f"unknown format {fmt!r}; use 'csv' or 'parquet'")
    reader = spark.read.option("header", True).option("mode", malformed)
    if schema is None:
        reader = reader.option("inferSchema", True)
    else:
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path)


@dataclass
class Checked:
    """``accepted`` rows in the schema asked for, ``rejected (line, reason)``, and ``counts (accepted, rejected)``."""

    accepted: DataFrame
    rejected: DataFrame
    counts: DataFrame


def read_checked(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType = TXN,
    required: Sequence[str] = (),
) -> Checked:
    """Read CSV and keep what does not fit the schema, with its text, instead of nulling its fields.

    A line is rejected that has too few or too many fields, a field of another type (``malformed``),
    or nothing in a ``required`` column (``missing``).  The text is parsed once: what the parser finds
    is stored in the shared folder, split by a flag, and rows, rejects and counts are read from there.
    A header that disagrees with the schema is an error, as in :func:`read_transactions`.
    """
    line = "__line"
    if line in schema.names:
        raise ValueError(f"the schema has a column {line}")
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField(line, T.StringType())]))
    options = {"header": True, "enforceSchema": False, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": line}
    parsed = reader.options(**options).csv(path)
    absent = [F.col(c).isNull() for c in required]
    lacking = reduce(lambda a, b: a | b, absent) if absent else F.lit(False)
    whole = F.to_csv(F.struct(*[F.col(c) for c in schema.names]))
    reason = F.when(F.col(line).isNotNull(), "malformed").when(lacking, "missing")
    stored = materialised(
        parsed.select(*schema.names, reason.alias("__reason"), F.when(reason.isNotNull(), F.coalesce(line, whole)).alias(line))
    )
    taken = F.col("__reason").isNull()
    return Checked(
        stored.filter(taken).select(*schema.names),
        stored.filter(~taken).select(F.col(line).alias("line"), F.col("__reason").alias("reason")),
        stored.agg(F.count_if(taken).alias("accepted"), F.count_if(~taken).alias("rejected")),
    )


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> DataFrame:
    """Write ``df`` so that exactly the partitions it has rows for are replaced, and return the table.

    Rows are written to a staging folder beside the table; when all tasks are done, the job's commit
    moves each new partition into the place of the old one.  So writing the same rows again changes
    nothing, a job lost before its commit leaves the table as it was, and one lost during the commit is
    put right by running it again.  ``df`` must not read the partitions that it replaces.
    """
    if not partition_by:
        raise ValueError("name the columns of the partitions")
    out = df.hint("rebalance", *partition_by)
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)
    return read_transactions(df.sparkSession, path, "parquet", _stored_schema(df, partition_by))


def _stored_schema(df: DataFrame, partition_by: Sequence[str]) -> T.StructType:
    """The columns of the files, then those of the partitions."""
    inside = [f for f in df.schema if f.name not in partition_by]
    return T.StructType(inside + [df.schema[name] for name in partition_by])


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> DataFrame:
    """Write ``df`` and return the stored table.

    Partitioned writes are rebalanced on the partition columns first: each
    value lands in few files of the advisory size, and a value that holds a
    large share of the rows is divided among several tasks.  CSV files are
    compressed, start with a header each and hold a bounded number of rows.
    """
    spark = df.sparkSession
    out = df.hint("rebalance", *partition_by) if partition_by else df
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.options(**CSV_WRITE).csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}; use 'csv' or 'parquet'")
    return read_transactions(spark, path, fmt, _stored_schema(df, partition_by))
