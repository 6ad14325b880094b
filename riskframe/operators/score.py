"""Applying a fitted model and turning scores into decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import positive_probability
from riskframe.sources.schema import LABEL


def score(
    model: PipelineModel, df: DataFrame, keep: Sequence[str] = (LABEL,), out: str = "score"
) -> DataFrame:
    """``keep`` columns, the probability of the positive class, and the decision.

    Vector columns are dropped, so the result is narrow and can be stored.
    """
    return model.transform(df).select(
        *keep, positive_probability("probability").alias(out), "prediction"
    )


def decide(
    df: DataFrame, threshold: float | Column, score: str = "score", out: str = "decision"
) -> DataFrame:
    """1.0 where ``score >= threshold``, else 0.0; a null score stays null."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    value = F.col(score)
    return df.withColumn(out, F.when(value.isNull(), F.lit(None)).otherwise((value >= cut).cast("double")))
