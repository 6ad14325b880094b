"""Classifier quality as tables.

Labels are 0/1.  Rows without such a label, or without a score, cannot be
counted and are left out by every operator here; ``report`` says how many were
used and left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.columns import bucket, count_where, percent
from riskframe.session import materialised
from riskframe.sources.schema import LABEL, THRESHOLDS


# --- decisions -------------------------------------------------------------


def _counted(condition: Column, weight: str | None) -> Column:
    """How many rows meet ``condition``, each as often as its ``weight`` says."""
    if weight is None:
        return count_where(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))


def confusion(
    df: DataFrame,
    label: str = LABEL,
    prediction: str = "prediction",
    by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """TP, TN, FP, FN, detection and false-alarm rate in percent, in one pass.

    ``weight`` names a column of whole numbers when rows stand for several.
    """
    cells = df.groupBy(*by).agg(
        *[
            _counted((F.col(label) == actual) & (F.col(prediction) == decided), weight).alias(name)
            for name, actual, decided in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))
        ]
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return cells.withColumns(
        {
            "detection_rate_pct": percent(tp, tp + fn, 1),
            "false_alarm_rate_pct": percent(fp, fp + tn, 4),
        }
    )


def _zero_if_empty(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _zero_if_empty(2 * precision * recall, precision + recall)


def _positive_rates() -> dict[str, Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = _zero_if_empty(tp, tp + fp), _zero_if_empty(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": _f1(p, r)}


def _weighted_rates() -> dict[str, Column]:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    pos, neg = tp + fn, tn + fp
    pp, pr = _zero_if_empty(tp, tp + fp), _zero_if_empty(tp, pos)
    np, nr = _zero_if_empty(tn, tn + fn), _zero_if_empty(tn, neg)

    def mean(of_pos: Column, of_neg: Column) -> Column:
        return F.try_divide(pos * of_pos + neg * of_neg, pos + neg)

    return {
        "weighted_precision": mean(pp, np),
        "weighted_recall": mean(pr, nr),
        "weighted_f1": mean(_f1(pp, pr), _f1(np, nr)),
    }


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def positive_prf(df: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Precision, recall and F1 of the positive class; 0 where undefined."""
    return confusion(df, label, prediction).select(*_named(_positive_rates()))


def weighted_prf(df: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Precision, recall and F1 averaged over both classes by their support."""
    return confusion(df, label, prediction).select(*_named(_weighted_rates()))


# --- thresholds ------------------------------------------------------------


def threshold_sweep(
    df: DataFrame,
    label: str = LABEL,
    score: str = "score",
    thresholds: Sequence[float] = THRESHOLDS,
) -> DataFrame:
    """Outcome of deciding ``score >= t`` for every threshold ``t``.

    One pass: a row is counted once, in the step between two thresholds that
    its score lies in.  The counts per threshold are running sums over those
    ``len(thresholds) + 1`` steps.
    """
    cuts = sorted(set(float(t) for t in thresholds))
    rows = df.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull())
    counts = rows.select(bucket(score, cuts).alias("step"), F.col(label).alias("y")).groupBy("step").agg(
        count_where(F.col("y") == 1).alias("p"), count_where(F.col("y") == 0).alias("n")
    )
    none = df.sparkSession.range(len(cuts) + 1).select(
        F.col("id").cast("int").alias("step"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("n")
    )
    steps = counts.unionByName(none).groupBy("step").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    # Unpartitioned windows: the input has one row per step.
    from_here = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    tp, fp = F.sum("p").over(from_here), F.sum("n").over(from_here)
    outcome = (
        steps.select(
            "step",
            tp.alias("tp"),
            fp.alias("fp"),
            (F.sum("p").over(everything) - tp).alias("fn"),
            (F.sum("n").over(everything) - fp).alias("tn"),
        )
        .filter(F.col("step") > 0)
        .withColumn("threshold", F.array(*[F.lit(t) for t in cuts])[F.col("step") - 1])
    )
    rates = outcome.withColumns(
        {
            "caught_pct": F.coalesce(percent(F.col("tp"), F.col("tp") + F.col("fn"), 1), F.lit(0.0)),
            "precision": _zero_if_empty(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": _zero_if_empty(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )
    return rates.withColumn("f1", _f1(F.col("precision"), F.col("recall"))).select(
        "threshold", "tp", "fp", "fn", "tn", "caught_pct", "precision", "recall", "f1"
    )


def best_threshold(sweep: DataFrame, default: float = 0.5) -> DataFrame:
    """The threshold of highest F1, the lowest such on ties.

    ``default`` is returned when no threshold reaches an F1 above 0.
    """
    fallback = sweep.sparkSession.range(1).select(
        F.lit(float(default)).alias("threshold"), F.lit(0.0).alias("f1")
    )
    return (
        sweep.filter(F.col("f1") > 0)
        .select("threshold", "f1")
        .unionByName(fallback)
        .orderBy(F.desc("f1"), "threshold")
        .limit(1)
    )


# --- ranking ---------------------------------------------------------------


def _range_edges(df: DataFrame, score: str, ranges: int) -> list[float]:
    """Inner edges that cut the scores into about ``ranges`` equal parts."""
    if ranges < 2:
        return []
    probabilities = [i / ranges for i in range(1, ranges)]
    found = df.approxQuantile(score, probabilities, 1 / (4 * ranges))
    return sorted({edge for edge in found if math.isfinite(edge)})


def ranking(
    df: DataFrame,
    label: str = LABEL,
    score: str = "score",
    by: Sequence[str] = (),
    ranges: int | None = None,
    bins: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Area under the ROC and the precision-recall curve, exact for any size.

    Both areas need running counts over all distinct scores.  No task sees all
    of them: the scores are first merged per distinct value, which also folds
    tied scores map-side, and stored.  That table of distinct scores, not the
    rows, is cut into ``ranges`` of about equal size (by default one per shuffle
    partition), however many rows tie.  Counts run inside a range and start from
    the totals of the ranges above it, of which there are only ``ranges`` many.
    The input is read once.

    ``bins`` rounds scores down to a grid first, trading exactness for fewer
    distinct scores.  With one class only the areas are null.  ``weight`` names a
    column of whole numbers when rows stand for several.
    """
    spark = df.sparkSession
    if ranges is None:
        ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = list(by)
    value = F.col(score).cast("double")
    if bins is not None:
        value = F.floor(value * bins) / bins
    rows = df.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull()).select(
        *keys,
        value.alias("s"),
        F.col(label).cast("int").alias("y"),
        *([] if weight is None else [F.col(weight).alias("w")]),
    )
    weighing = None if weight is None else "w"
    groups = rows.groupBy(*keys, "s").agg(
        _counted(F.col("y") == 1, weighing).alias("p"), _counted(F.col("y") == 0, weighing).alias("n")
    )
    groups = materialised(groups)
    edges = _range_edges(groups, "s", ranges)
    splits = [float("-inf"), *edges, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="s", outputCol="r", handleInvalid="keep")
    groups = cut.transform(groups) if edges else groups.withColumn("r", F.lit(0.0))

    # At most `ranges` + 1 rows per key combination.
    per_range = groups.groupBy(*keys, "r").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    above = Window.partitionBy(*keys).orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    starts = per_range.select(
        *keys,
        "r",
        F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("tp0"),
        F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("fp0"),
        F.sum("rp").over(whole).alias("pp"),
        F.sum("rn").over(whole).alias("nn"),
    )
    # One row per key and range; Spark's size check decides how to join.
    starts = starts.withColumnsRenamed({c: f"__{c}" for c in (*keys, "r")})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, "r")])
    joined = groups.join(starts, same)

    down = (
        Window.partitionBy(*keys, "r")
        .orderBy(F.desc("s"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    p, n, pp, nn = (F.col(c).cast("double") for c in ("p", "n", "pp", "nn"))
    counted = joined.select(
        *keys,
        p.alias("p"),
        n.alias("n"),
        pp.alias("pp"),
        nn.alias("nn"),
        (F.col("tp0") + F.sum("p").over(down)).cast("double").alias("tp"),
        (F.col("fp0") + F.sum("n").over(down)).cast("double").alias("fp"),
    )
    tp, fp = F.col("tp"), F.col("fp")
    before = F.try_divide(tp - F.col("p"), tp - F.col("p") + fp - F.col("n"))
    precision = tp / (tp + fp)
    roc_part = F.try_divide(F.col("n"), F.col("nn")) * F.try_divide(
        tp - F.col("p") / 2, F.col("pp")
    )
    pr_part = (
        F.try_divide(F.col("p"), F.col("pp"))
        * (precision + F.coalesce(before, precision))
        / 2
    )
    areas = counted.groupBy(*keys).agg(
        F.sum(roc_part).alias("roc_auc"),
        F.sum(pr_part).alias("pr_auc"),
        F.max("pp").cast("bigint").alias("positives"),
        F.max("nn").cast("bigint").alias("negatives"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return areas.select(
        *keys,
        F.when(both, F.col("roc_auc")).alias("roc_auc"),
        F.when(both, F.col("pr_auc")).alias("pr_auc"),
        F.coalesce("positives", F.lit(0)).alias("positives"),
        F.coalesce("negatives", F.lit(0)).alias("negatives"),
    )


def roc_auc(df: DataFrame, label: str = LABEL, score: str = "score", **options) -> DataFrame:
    return ranking(df, label, score, **options).select(*options.get("by", ()), "roc_auc")


def pr_auc(df: DataFrame, label: str = LABEL, score: str = "score", **options) -> DataFrame:
    return ranking(df, label, score, **options).select(*options.get("by", ()), "pr_auc")


# --- report ----------------------------------------------------------------


def _long(df: DataFrame) -> DataFrame:
    values = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
    return values.unpivot([], values.columns, "metric", "value")


def report(
    df: DataFrame, label: str = LABEL, score: str = "score", prediction: str = "prediction"
) -> DataFrame:
    """All metrics as ``(metric, value)`` rows.

    Rows without a label 0 or 1, a score or a decision are left out of all
    figures; ``left_out`` and ``left_out_positives`` count them.  All but the
    two areas come from one aggregate.
    """
    usable = F.coalesce(
        F.col(label).isin(0, 1) & F.col(score).isNotNull() & F.col(prediction).isin(0, 1), F.lit(False)
    )
    cells = {
        name: count_where(usable & (F.col(label) == actual) & (F.col(prediction) == decided))
        for name, actual, decided in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))
    }
    left = {
        "left_out": count_where(~usable),
        "left_out_positives": count_where(~usable & (F.col(label) == 1)),
    }
    tp, tn, fp, fn = (F.col(c) for c in cells)
    figures = {
        "rows": tp + tn + fp + fn,
        "detection_rate_pct": percent(tp, tp + fn, 1),
        "false_alarm_rate_pct": percent(fp, fp + tn, 4),
        **_positive_rates(),
        **_weighted_rates(),
    }
    counted = df.agg(*_named({**cells, **left})).select("*", *_named(figures))
    areas = ranking(df.filter(usable), label, score).select("roc_auc", "pr_auc")
    return _long(counted).unionByName(_long(areas))
