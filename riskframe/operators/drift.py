"""Change over time: amount distribution and model quality per time bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.functions import columns as C
from riskframe.operators import evaluate
from riskframe.sources.schema import AMOUNT, AMOUNT_BOUNDS, LABEL
from riskframe.sources.tables import replace_partitions


def shift_amount(
    df: DataFrame, bucket: str, rate: float, amount: str = AMOUNT
) -> DataFrame:
    """Raise the amount by ``rate`` per time bucket, to provoke drift."""
    return df.withColumn(amount, F.col(amount) * (1 + F.lit(rate) * F.col(bucket)))


def amount_counts(
    df: DataFrame,
    bucket: str,
    col: str = AMOUNT,
    bounds: Sequence[float] = tuple(AMOUNT_BOUNDS),
) -> DataFrame:
    """``(<bucket>, rows, missing, b0, b1, ...)``: one row of bin counts per bucket, in one pass."""
    step = C.bucket(col, bounds)
    return df.groupBy(bucket).agg(
        F.count(col).alias("rows"),
        C.count_where(F.col(col).isNull()).alias("missing"),
        *[C.count_where(step == i).alias(f"b{i}") for i in range(len(bounds) + 1)],
    )


def drift_of_counts(counts: DataFrame, bucket: str, baseline: int | str) -> DataFrame:
    """:func:`amount_drift` from a table of :func:`amount_counts`, one row per bucket."""
    names = [c for c in counts.columns if c not in (bucket, "rows", "missing")]
    # An unpartitioned window over one row per bucket.
    here = F.col(bucket).eqNullSafe(F.lit(baseline))
    base = F.max(F.when(here, F.struct("rows", *names))).over(Window.partitionBy())
    compared = counts.withColumn("base", base)

    def share(hits, total):
        return (hits + F.lit(0.5)) / (total + F.lit(0.5 * len(names)))

    psi = F.lit(0.0)
    for name in names:
        p = share(F.col(name), F.col("rows"))
        q = share(F.col("base")[name], F.col("base")["rows"])
        psi = psi + (p - q) * F.ln(p / q)
    known = (F.col("rows") > 0) & (F.col("base")["rows"] > 0)
    return compared.select(bucket, "rows", "missing", F.when(known, psi).alias("psi"))


def amount_drift(
    df: DataFrame,
    bucket: str,
    baseline: int | str,
    col: str = AMOUNT,
    bounds: Sequence[float] = tuple(AMOUNT_BOUNDS),
) -> DataFrame:
    """Population stability index of every bucket against the baseline bucket.

    Half a row is added to every bin, so an empty bin has a finite logarithm.
    ``rows`` counts the rows with an amount, ``missing`` those without.  A bucket
    without amounts has a null index, and so has every bucket when the baseline
    bucket has none.  The rows are aggregated once, to one row of bin counts per
    bucket; the baseline's counts are taken from those rows.
    """
    return drift_of_counts(amount_counts(df, bucket, col, bounds), bucket, baseline)


def quality_drift(
    df: DataFrame,
    bucket: str,
    label: str = LABEL,
    score: str = "score",
    prediction: str = "prediction",
) -> DataFrame:
    """Confusion counts, rates and areas under the curves per time bucket, the null bucket included."""
    cells = evaluate.confusion(df, label, prediction, by=[bucket])
    areas = evaluate.ranking(df, label, score, by=[bucket]).select(
        F.col(bucket).alias("__bucket"), "roc_auc", "pr_auc"
    )
    return cells.join(areas, F.col(bucket).eqNullSafe(F.col("__bucket")), "left").drop("__bucket")


# --- rows that arrive over time ---------------------------------------------


def quality_counts(
    df: DataFrame,
    bucket: str,
    label: str = LABEL,
    score: str = "score",
    prediction: str = "prediction",
) -> DataFrame:
    """``(<bucket>, score, prediction, label, n)``: rows that agree in all of them are one, counted map-side.

    Areas and confusion counts need no more than this.
    """
    return df.groupBy(
        bucket,
        F.col(score).cast("double").alias("score"),
        F.col(prediction).cast("double").alias("prediction"),
        F.col(label).cast("int").alias("label"),
    ).agg(F.count(F.lit(1)).alias("n"))


def quality_drift_of_counts(counts: DataFrame, bucket: str) -> DataFrame:
    """:func:`quality_drift` from a table of :func:`quality_counts`."""
    cells = evaluate.confusion(counts, "label", "prediction", by=[bucket], weight="n")
    areas = evaluate.ranking(counts, "label", "score", by=[bucket], weight="n").select(
        F.col(bucket).alias("__bucket"), "roc_auc", "pr_auc"
    )
    return cells.join(areas, F.col(bucket).eqNullSafe(F.col("__bucket")), "left").drop("__bucket")


class DriftState:
    """Counts per bucket of all rows loaded so far, kept as a table of one partition per load.

    ``load`` counts the rows of one delivery and replaces that delivery's partition, so a delivery that
    is repeated, or whose job was lost half way, counts once.  Reading adds the partitions up: counts
    are sums, so any order and any division into loads gives what one load of everything gives.  A
    load reads its own rows only; the state grows with buckets and distinct scores, not with rows.
    """

    LOAD = "load_id"

    def __init__(self, spark: SparkSession, path: str, bucket: str) -> None:
        self._spark, self._path, self._bucket = spark, path.rstrip("/"), bucket

    def load(self, rows: DataFrame, load_id: str, kind: str = "amount", **options) -> None:
        """Count ``rows`` as delivery ``load_id``; ``options`` are those of ``amount_counts`` or ``quality_counts``."""
        counts = {"amount": amount_counts, "quality": quality_counts}[kind](rows, self._bucket, **options)
        replace_partitions(counts.withColumn(self.LOAD, F.lit(load_id)), f"{self._path}/{kind}", [self.LOAD])

    def counts(self, kind: str = "amount") -> DataFrame:
        """All loads together, in the form a single load's counts have."""
        stored = self._spark.read.parquet(f"{self._path}/{kind}").drop(self.LOAD)
        if kind == "quality":
            return stored.groupBy(self._bucket, "score", "prediction", "label").agg(F.sum("n").alias("n"))
        sums = [c for c in stored.columns if c != self._bucket]
        return stored.groupBy(self._bucket).agg(*[F.sum(c).alias(c) for c in sums])

    def amount_drift(self, baseline: int | str) -> DataFrame:
        return drift_of_counts(self.counts("amount"), self._bucket, baseline)

    def quality_drift(self) -> DataFrame:
        return quality_drift_of_counts(self.counts("quality"), self._bucket)
