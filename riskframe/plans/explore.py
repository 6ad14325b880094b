"""The five exploratory queries over one transaction table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators import features, profile
from riskframe.sources.schema import AMOUNT, COMPONENTS, LABEL, TIME


def explore(df: DataFrame, tiebreak: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Name to result table; nothing runs until a table is used."""
    return {
        "class_distribution": profile.class_distribution(df),
        "rate_by_amount_bracket": profile.rate_by_bucket(
            features.bucketize(df), "bracket", amount=AMOUNT
        ),
        "rate_by_hour": profile.rate_by_bucket(features.hour_bucket(df), "hour"),
        "class_means": profile.class_means(df, COMPONENTS[:5]),
        "top_positive": profile.top_k(
            df,
            AMOUNT,
            10,
            where=F.col(LABEL) == 1,
            columns=[*tiebreak, TIME, AMOUNT, *COMPONENTS[:3], LABEL],
            tiebreak=tiebreak,
        ),
    }
