"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_CHARS = 2_000_000
CHUNK_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, text: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part but a single long text holds more than ``chars`` bytes of text."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch[text]), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside send Python at most ``rows`` rows at a time: for rows that may be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(df: DataFrame, by: str, spread: Column, out: str, rows: int) -> DataFrame:
    """Number the rows of every value of ``by`` gapless from 0, without putting a value into one task.

    ``spread`` (a hash of the row's identity) deals the rows to ``rows / CHUNK_ROWS`` chunks; rows are
    numbered within ``(by, chunk)`` and chunks start where the ones before end.  Only the chunk
    totals, one row per ``(by, chunk)``, meet in a window over ``by``.  ``df`` is read twice, so it
    should be a stored table.
    """
    chunks = max(1, -(-rows // CHUNK_ROWS))
    dealt = df.withColumn("__chunk", F.pmod(spread, F.lit(chunks)))
    totals = dealt.groupBy(by, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col(by).alias("__by"),
        F.col("__chunk").alias("__at"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
    )
    inside = Window.partitionBy(by, "__chunk").orderBy(spread)
    placed = dealt.withColumn("__row", F.row_number().over(inside) - 1)
    return (
        placed.join(starts, (F.col("__by").eqNullSafe(F.col(by))) & (F.col("__at") == F.col("__chunk")))
        .withColumn(out, F.col("__start") + F.col("__row"))
        .drop("__by", "__at", "__start", "__row", "__chunk")
    )
