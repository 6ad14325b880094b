"""Feature columns.  Projections only, except for fitting the scaler."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions import columns as C
from riskframe.sources.schema import (
    AMOUNT,
    AMOUNT_BOUNDS,
    AMOUNT_BRACKETS,
    INTERACTIONS,
    SQUARES,
    TIME,
)


def bucketize(
    df: DataFrame,
    col: str = AMOUNT,
    bounds: Sequence[float] = tuple(AMOUNT_BOUNDS),
    labels: Sequence[str] = tuple(AMOUNT_BRACKETS),
    out: str = "bracket",
) -> DataFrame:
    """Name the half-open interval each value lies in; null stays null."""
    return df.withColumn(out, C.bucket(col, bounds, labels))


def hour_bucket(
    df: DataFrame, col: str = TIME, width: float = 3600, out: str = "hour"
) -> DataFrame:
    """Number the windows of ``width`` seconds."""
    return df.withColumn(out, C.time_bucket(col, width))


def log1p(df: DataFrame, col: str = AMOUNT, out: str | None = None) -> DataFrame:
    """``ln(col + 1)``, which is 0 for 0."""
    return df.withColumn(out or f"{col}_log", F.log1p(col))


def interactions(
    df: DataFrame, pairs: Sequence[tuple[str, str]] = tuple(INTERACTIONS)
) -> DataFrame:
    """The product of every pair, as ``a_x_b``."""
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def squares(df: DataFrame, cols: Sequence[str] = tuple(SQUARES)) -> DataFrame:
    """The square of every column, as ``a_squared``."""
    return df.withColumns({f"{name}_squared": F.col(name) * F.col(name) for name in cols})


def engineered(df: DataFrame) -> DataFrame:
    """The tuned recipe's five extra columns."""
    return squares(interactions(log1p(df)))


def valid_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which none of the numeric columns is null or NaN."""
    checks = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols]
    return df.filter(reduce(lambda a, b: a & b, checks))


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample standard deviation per column: one pass, one row per column back.

    The columns are turned into rows before the map-side aggregation; dozens of
    moment aggregates side by side outgrow what the JVM compiles.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    moments = (
        values.unpivot([], list(cols), "col", "value")
        .groupBy("col")
        .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    )
    found = {row["col"]: (row["mean"], row["std"]) for row in moments.collect()}
    return {c: found.get(c, (None, None)) for c in cols}


def standardize(
    df: DataFrame,
    cols: Sequence[str],
    stats: Mapping[str, tuple[float, float]] | None = None,
    suffix: str = "_std",
) -> DataFrame:
    """Shift to mean 0 and scale to deviation 1; a constant column becomes 0.

    Pass the ``stats`` fitted on the training side to score other rows.  They
    enter the plan as literals, so no join or second scan is planned.
    """
    stats = fit_scaler(df, cols) if stats is None else stats
    out = {}
    for name in cols:
        mean, std = stats[name]
        if mean is None:
            out[name + suffix] = F.lit(None).cast("double")
        else:
            scale = 1.0 / std if std else 0.0
            out[name + suffix] = (F.col(name) - F.lit(mean)) * F.lit(scale)
    return df.withColumns(out)
