"""Token ids as Parquet list columns that can be read in part.

Documents are range-partitioned by identifier, encoded, and written with Spark's own Parquet writer:
the ids as a list column in dictionary or delta encoding, a row of metadata beside it, row groups and
pages of chosen sizes, and the page index that the writer always adds.  Within and across files rows
ascend by identifier, so a filter on it prunes row groups and pages, and a read of the metadata alone
never touches the ids.

Defined results: a null text is an empty one and holds only ``end_id``; null identifiers come first;
equal identifiers stay next to each other, ordered by their text; an empty table gives an empty
folder that reads back as no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import slices
from riskframe.llm.tokens import default_path, encoder

IDS = "ids.list.element"


def write_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 1 << 20,
    page_rows: int = 2_000,
    tokenizer: str | None = None,
) -> None:
    """Encode whole texts and write ``(doc_id, n_tokens, file, first, ids)`` below ``path``.

    ``file`` numbers the files in ascending order of identifiers; ``first`` counts the ids before a
    document in its own file.  ``encoding`` is ``dictionary`` or ``delta`` (binary-packed deltas).
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    vocabulary = tokenizer or default_path()
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    schema = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("file", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, file, before = to_arrow_schema(schema), TaskContext.get().partitionId(), 0
        last = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                coded = [ids + last for ids in encoder(vocabulary).encode(part["text"].to_pylist())]
                counts = np.asarray([len(c) // 4 for c in coded], dtype=np.int64)
                ends = np.cumsum(counts)
                bounds = pa.array(np.concatenate([[0], ends]), pa.int32())
                flat = pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32))
                columns = [
                    part["doc_id"],
                    pa.array(counts),
                    pa.array(np.full(len(coded), file, dtype=np.int32)),
                    pa.array(before + ends - counts),
                    pa.ListArray.from_arrays(bounds, flat).cast(out.field("ids").type),
                ]
                before += int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    writer = ordered.mapInArrow(run, schema).write
    options = {
        "compression": "zstd",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        f"parquet.enable.dictionary#{IDS}": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "v2" if encoding == "delta" else "v1",
    }
    writer.options(**options).parquet(path)


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """``(at, before)``: the ids in all files before.

    One row per file, of which the writer makes no more than shuffle partitions: a side to broadcast.
    """
    sizes = spark.read.parquet(path).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(
        sizes.select(F.col("file").alias("at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens)`` without reading any ids."""
    rows = spark.read.parquet(path)
    return rows.join(_starts(spark, path), F.col("file") == F.col("at")).select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens"
    )


def read_tokens(spark: SparkSession, path: str, low=None, high=None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of the identifiers from ``low`` to ``high``, both included."""
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= F.lit(low))
    if high is not None:
        rows = rows.filter(F.col("doc_id") <= F.lit(high))
    return rows.join(_starts(spark, path), F.col("file") == F.col("at")).select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids"
    )


def checksums(tokens: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``, the unsigned crc32 of the ids as little-endian 32-bit numbers."""
    schema = T.StructType([f for f in tokens.schema if f.name != "ids"]).add("ids_crc32", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["ids"]
            flat = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4")
            ends = np.cumsum(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False))
            sums = [zlib.crc32(part) for part in np.split(flat, ends[:-1])] if len(ids) else []
            rest = [batch[f.name] for f in schema if f.name != "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sums, pa.int64())], names=schema.names)

    return tokens.mapInArrow(run, schema)
