"""Class counts and balanced class weights ``total / (2 * rows_of_class)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import count_where, percent
from riskframe.sources.schema import LABEL, WEIGHT


def _counts(df: DataFrame, label: str) -> DataFrame:
    """One row; every class is present even when it has no rows."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        count_where(F.col(label) == 1).alias("pos"),
        count_where(F.col(label) == 0).alias("neg"),
    )


def _per_class(counts: DataFrame, label: str) -> DataFrame:
    return counts.select("total", F.expr(f"stack(2, 0, neg, 1, pos) as (`{label}`, n)"))


def class_counts(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows and share in percent of each class, from a single scan."""
    return _per_class(_counts(df, label), label).select(
        label, "n", percent(F.col("n"), F.col("total"), 4).alias("pct")
    )


def balanced(df: DataFrame, label: str = LABEL) -> DataFrame:
    """``(label, n, weight)``, one row per class; null weight for an empty class."""
    return _per_class(_counts(df, label), label).select(
        label, "n", F.try_divide(F.col("total"), 2.0 * F.col("n")).alias("weight")
    )


def fit(df: DataFrame, label: str = LABEL) -> dict[int, float | None]:
    """The two weights as numbers, for plans that are run many times."""
    return {row[label]: row["weight"] for row in balanced(df, label).collect()}


def attach(
    df: DataFrame,
    weights: dict[int, float | None] | None = None,
    label: str = LABEL,
    out: str = WEIGHT,
) -> DataFrame:
    """Give every row the weight of its class.

    Without ``weights`` they come from ``df`` itself through a one-row scalar
    subquery, which Spark evaluates once and inlines: no join and no shuffle of
    the rows.
    """
    if weights is None:
        row = _counts(df, label).select(
            F.struct(
                F.try_divide(F.col("total"), 2.0 * F.col("pos")).alias("pos"),
                F.try_divide(F.col("total"), 2.0 * F.col("neg")).alias("neg"),
            ).alias("w")
        ).scalar()
        pos, neg = row["pos"], row["neg"]
    else:
        pos, neg = (F.lit(weights[k]).cast("double") for k in (1, 0))
    return df.withColumn(out, F.when(F.col(label) == 1, pos).otherwise(neg))
