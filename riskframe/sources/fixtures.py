"""Stand-ins for the card-transaction table, derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.sources.schema import AMOUNT, COMPONENTS, LABEL, TIME


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``txn_id, Time, V1..V28, Amount, Class`` from lineitem and embeddings."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # Order keys are dealt over all vectors, whose identifiers count from 0; the
    # join is left to Spark's own size check.
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    count = vectors.agg(F.count(F.lit(1))).scalar()
    days = F.date_diff(F.col("l_shipdate"), F.lit("1995-01-01").cast("timestamp"))
    fraud = (F.col("label") == 0) & (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09)
    return lines.withColumn("slot", F.pmod("l_orderkey", count)).join(
        vectors, F.col("slot") == F.col("vec_id")
    ).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", days).alias("txn_id"),
        (days * 60).cast("double").alias(TIME),
        *[F.col("embedding")[i].cast("double").alias(name) for i, name in enumerate(COMPONENTS)],
        (F.col("l_extendedprice") * F.col("l_discount")).alias(AMOUNT),
        F.when(fraud, 1).otherwise(0).alias(LABEL),
    )


def txn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, Time, Amount, Class`` from events; an error is a positive."""
    start = F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        (F.unix_timestamp(F.col("ts").cast("timestamp")) - start).alias(TIME),
        F.col("value").alias(AMOUNT),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias(LABEL),
    )


def scored(df: DataFrame) -> DataFrame:
    """Add a deterministic score built from two components and the amount."""
    logit = F.col("V14") + F.col("V4") - F.col(AMOUNT) / 5000
    return df.withColumn("score", F.round(1 / (1 + F.exp(-logit)), 6))
