"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from riskframe.operators import (  # noqa: E402
    drift,
    evaluate,
    features,
    profile,
    sampling,
    synthetic,
    train,
    weights,
)
from riskframe.operators.score import decide, score  # noqa: E402
from riskframe.plans.baseline import baseline  # noqa: E402
from riskframe.plans.explore import explore  # noqa: E402
from riskframe.plans.scaling import scaling  # noqa: E402
from riskframe.plans.tuned import tuned  # noqa: E402
from riskframe.session import shared_path  # noqa: E402
from riskframe.sources import fixtures  # noqa: E402
from riskframe.functions.columns import bucket, hash_slot  # noqa: E402
from riskframe.sources.schema import (  # noqa: E402
    AMOUNT,
    BASE_FEATURES,
    COMPONENTS,
    LABEL,
    OVERSAMPLING,
    TIME,
    TUNING_GRID,
    TXN,
)
from riskframe.sources.tables import (  # noqa: E402
    CSV_WRITE,
    read_checked,
    read_transactions,
    replace_partitions,
    write_table,
)

try:  # The training-data operators are an optional part.
    import corpus_pipeline
    from riskframe.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "riskframe.llm"):
        raise
    corpus_pipeline = llm = None

Query = Callable[[SparkSession, str], DataFrame]

BASELINE_BUCKET = 0
ABSENT_BUCKET = 99


def entry(spark: SparkSession) -> DataFrame:
    """Baseline study on the smallest scale: the metrics of a held-out side."""
    return _baseline(spark, "/root/testdata/sf0.001").report


def _cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def _txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return fixtures.txn(spark, sf_dir)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return fixtures.txn_events(spark, sf_dir)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.scored(_txn(spark, sf_dir))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(_scored(spark, sf_dir), 0.5, out="prediction")


def _on(table: Callable[[SparkSession, str], DataFrame], operator) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir))


def _study(name: str) -> Query:
    return lambda spark, sf_dir: explore(_txn(spark, sf_dir), ["txn_id"])[name]


def _valid_rows(df: DataFrame) -> DataFrame:
    # Null amounts at the smallest bracket, NaN for the highest component values.
    holed = df.select(
        "txn_id",
        F.when(F.col(AMOUNT) >= 10, F.col(AMOUNT)).alias(AMOUNT),
        F.when(F.col("V1") > 0.3, F.lit(float("nan"))).otherwise(F.col("V1")).alias("V1"),
    )
    return features.valid_rows(holed, [AMOUNT, "V1"]).select("txn_id", AMOUNT)


def _weighted_totals(df: DataFrame) -> DataFrame:
    return (
        df.groupBy(LABEL)
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("classWeight"), 6).alias("weight_sum"))
    )


def _standardized(df: DataFrame) -> DataFrame:
    cols = [TIME, "V1", "V14", AMOUNT]
    return features.standardize(df, cols).select(
        "txn_id", *[F.round(F.col(f"{c}_std"), 6).alias(f"{c}_std") for c in cols]
    )


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def _final_decision(df: DataFrame) -> DataFrame:
    best = evaluate.best_threshold(evaluate.threshold_sweep(df))
    cut = best.select("threshold").scalar()
    return evaluate.confusion(decide(df, cut), prediction="decision")


def _hours(df: DataFrame) -> DataFrame:
    return features.hour_bucket(df)


def _parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _hours(_txn(spark, sf_dir)).select("hour", TIME, AMOUNT, LABEL)
    stored = write_table(df, shared_path(spark, "processed"), partition_by=["hour"])
    return profile.rate_by_bucket(stored, "hour")


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _txn(spark, sf_dir).drop("txn_id")
    stored = write_table(df, shared_path(spark, "raw"), fmt="csv")
    return profile.class_distribution(stored)


def _holed(df: DataFrame) -> DataFrame:
    """Hours with nulls: no hour for hour 5, no amount below 10 or in hour 7."""
    no_amount = (F.col(AMOUNT) < 10) | (F.col("hour") == 7)
    return _hours(df).select(
        "txn_id",
        F.when(F.col("hour") != 5, F.col("hour")).alias("hour"),
        F.when(~no_amount, F.col(AMOUNT)).alias(AMOUNT),
        *[c for c in (LABEL, "score", "prediction") if c in df.columns],
    )


def _left_out(df: DataFrame) -> DataFrame:
    """Scores and labels with nulls."""
    return df.select(
        F.when(F.col(AMOUNT) >= 5, F.col(LABEL)).alias(LABEL),
        F.when(F.col("V1") < 0.2, F.col("score")).alias("score"),
        "prediction",
    )


#: Studies of this session: several queries show one study's parts.
_studies: dict[tuple[str, str, str], object] = {}


def _once(kind: str, spark: SparkSession, sf_dir: str, study):
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _studies:
        _studies[key] = study()
    return _studies[key]


def _baseline(spark: SparkSession, sf_dir: str):
    """The baseline study with the published settings."""
    return _once(
        "baseline",
        spark,
        sf_dir,
        lambda: baseline(_txn(spark, sf_dir), "txn_id", keep=["txn_id", AMOUNT], partitions=_cores(spark)),
    )


def _tuned(spark: SparkSession, sf_dir: str):
    """The tuned study with the published grid, 8 settings in 3 folds."""
    cores = _cores(spark)

    def study():
        # Many fits at a time, so few splits each; a large table has more of them.
        return tuned(_txn(spark, sf_dir), "txn_id", parallelism=cores, partitions=max(1, cores // 4))

    return _once("tuned", spark, sf_dir, study)


def _gbt_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _baseline(spark, sf_dir).scored
    likely = F.when(F.col("score") > 0.5, 1.0).otherwise(0.0)
    return scored.select(
        "txn_id",
        LABEL,
        AMOUNT,
        F.col("score").between(0, 1).alias("is_probability"),
        (F.col("prediction") == likely).alias("decides_by_half"),
    )


def _gbt_scored_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = profile.top_k(
        _baseline(spark, sf_dir).scored,
        AMOUNT,
        10,
        where=F.col(LABEL) == 1,
        columns=["txn_id", LABEL, "prediction", AMOUNT],
        tiebreak=["txn_id"],
    )
    return top.withColumn("prediction", F.col("prediction").isin(0.0, 1.0))


def _gbt_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline(spark, sf_dir).importances.agg(
        F.count(F.lit(1)).alias("n"),
        (F.abs(F.sum("importance") - 1) < 1e-6).alias("sums_to_one"),
        (F.min("importance") >= 0).alias("none_negative"),
        (F.max("rank") == F.countDistinct("rank")).alias("ranked"),
    )


def _cv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = _tuned(spark, sf_dir).search.metrics
    whole = Window.partitionBy()  # one row per setting
    return metrics.select(
        *[F.col("params")[c].alias(c) for c in TUNING_GRID],
        F.sum(F.col("is_best").cast("int")).over(whole).cast("bigint").alias("best_settings"),
        (~F.col("is_best") | (F.col("avg_metric") == F.max("avg_metric").over(whole))).alias("best_is_largest"),
    )


def _tuned_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return _tuned(spark, sf_dir).sweep.select(
        "threshold", (tp + fn).alias("positives"), (fp + tn).alias("negatives")
    )


def _baseline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = {r["metric"]: r["value"] for r in _baseline(spark, sf_dir).report.collect()}  # 17 figures
    totals = (cells["rows"], cells["tp"] + cells["fn"], cells["tn"] + cells["fp"], cells["left_out"])
    return spark.createDataFrame([totals], "rows double, positives double, negatives double, left_out double")


def _scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = scaling(_txn(spark, sf_dir), "txn_id", partitions=_cores(spark))
    return curve.select("multiplier", "rows", "train_rows", F.col("roc_auc").between(0, 1).alias("is_area"))


#: A search small enough for SQL to boost the same trees: features of few values, so that every
#: value is a bin of its own.
STEPS = ("day_part", "size", "step14", "step4")
STEP_HOURS = 6
COMPONENT_STEPS = (-0.1, 0.0, 0.1)
SMALL_TREES = {"maxIter": 3, "maxDepth": 2, "stepSize": 0.3}
SMALL_GRID = {"maxIter": [2, 3], "maxDepth": [1, 2], "stepSize": [0.3]}


def _steps(df: DataFrame) -> DataFrame:
    """Add four features of four to seven values."""
    return df.withColumns(
        {
            "day_part": F.floor(F.col(TIME) / (3600 * STEP_HOURS)).cast("int"),
            "size": bucket(AMOUNT, [10.0, 100.0, 500.0, 1000.0]),
            # Column names ignore case, so these are not called v14 and v4.
            "step14": bucket("V14", COMPONENT_STEPS),
            "step4": bucket("V4", COMPONENT_STEPS),
        }
    )


def _stepped(df: DataFrame) -> DataFrame:
    """The stepped features, weights and folds."""
    steps = _steps(df).select("txn_id", LABEL, *STEPS)
    return sampling.hash_folds(weights.attach(steps), "txn_id")


def _small_model(spark: SparkSession, sf_dir: str):
    def study():
        rows = _stepped(_txn(spark, sf_dir))
        model = train.fit_gbt(rows, STEPS, params=SMALL_TREES, partitions=_cores(spark))
        return rows, model

    return _once("small", spark, sf_dir, study)


def _gbt_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _small_model(spark, sf_dir)
    return score(model, rows, keep=["txn_id"]).select("txn_id", F.round("score", 6).alias("score"), "prediction")


def _gbt_by_value_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = train.importances(_small_model(spark, sf_dir)[1], STEPS)
    return ranked.select("feature", F.round("importance", 6).alias("importance"), "rank")


def _gbt_by_value_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = train.tree_nodes(_small_model(spark, sf_dir)[1])
    return nodes.groupBy("tree").agg(
        F.count("feature").alias("splits"),
        F.sum(F.when(F.col("feature").isNull(), F.col("n"))).alias("rows"),
        F.round(F.max("weight"), 6).alias("weight"),
        F.round(F.max("value"), 6).alias("largest"),
        F.round(F.max(F.when(F.col("node") == 0, F.col("gain"))), 6).alias("first_gain"),
    )


def _cv_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cores = _small_model(spark, sf_dir)[0], _cores(spark)
    found = train.cross_validate(rows, STEPS, "fold", axes=SMALL_GRID, parallelism=cores, partitions=cores)
    return found.metrics.select(
        *[F.col("params")[c].cast("int").alias(c) for c in ("maxIter", "maxDepth")],
        F.round("avg_metric", 6).alias("avg_metric"),
        "is_best",
    )


def _baseline_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, splits = _steps(_txn(spark, sf_dir)), _cores(spark)
    return _rounded(baseline(rows, "txn_id", cols=STEPS, params=SMALL_TREES, partitions=splits).report, 6)


def _small_tuned(spark: SparkSession, sf_dir: str):
    def study():
        rows, cores = _steps(_txn(spark, sf_dir)), _cores(spark)
        return tuned(rows, "txn_id", cols=STEPS, axes=SMALL_GRID, parallelism=cores, partitions=max(1, cores // 4))

    return _once("small tuned", spark, sf_dir, study)


def _tuned_by_value_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_small_tuned(spark, sf_dir).sweep.select("threshold", "tp", "fp", "fn", "tn", "f1"), 6)


def _tuned_by_value_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = _small_tuned(spark, sf_dir)
    chosen = {"maxIter": study.search.best["maxIter"], "maxDepth": study.search.best["maxDepth"]}
    return study.final.select(
        *[F.lit(v).alias(name) for name, v in chosen.items()],
        F.lit(study.threshold).alias("threshold"),
        "tp", "tn", "fp", "fn", "detection_rate_pct", "false_alarm_rate_pct",
    )


def _smote(df: DataFrame) -> DataFrame:
    return _rounded(synthetic.smote(df, "txn_id", BASE_FEATURES), 6)


def _smote_events(df: DataFrame) -> DataFrame:
    return _rounded(synthetic.smote(df, "event_id", [TIME, AMOUNT], k=3, factor=3), 6)


def _knn_events(df: DataFrame) -> DataFrame:
    found = synthetic.nearest_neighbours(df.filter(F.col(LABEL) == 1), "event_id", [TIME, AMOUNT]).found
    return found.select(F.col("key").alias("event_id"), F.posexplode("neighbours").alias("rank", "near")).select(
        "event_id", "rank", F.col("near.key").alias("neighbour"), F.round("near.d", 6).alias("squared_distance")
    )


def _half(key: str):
    return hash_slot([key], 2, "half:")


def _drift_loads(spark: SparkSession, sf_dir: str, kind: str) -> drift.DriftState:
    """Two halves of the rows loaded one after the other, the second one twice."""
    df = _hours(_decided(spark, sf_dir))
    state = drift.DriftState(spark, shared_path(spark, "drift"), "hour")
    for load in (0, 1, 1):
        state.load(df.filter(_half("txn_id") == load), f"half-{load}", kind)
    return state


def _amount_drift_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_drift_loads(spark, sf_dir, "amount").amount_drift(BASELINE_BUCKET), 6)


def _quality_drift_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_drift_loads(spark, sf_dir, "quality").quality_drift(), 6)


def _partitions_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with wrong amounts in its even hours, which are then written again, twice."""
    df = _hours(_txn(spark, sf_dir)).select("hour", TIME, AMOUNT, LABEL)
    even = F.col("hour") % 2 == 0
    path = shared_path(spark, "processed")
    replace_partitions(df.withColumn(AMOUNT, F.when(even, F.lit(-1.0)).otherwise(F.col(AMOUNT))), path, ["hour"])
    for _ in range(2):
        stored = replace_partitions(df.filter(even), path, ["hour"])
    return stored.groupBy("hour").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum(AMOUNT), 4).alias("amount"), F.sum(LABEL).alias("positives")
    )


#: Lines before this time lose all but three fields.
SHORT_BEFORE = 4 * 3600


def _damaged(spark: SparkSession, sf_dir: str) -> str:
    """CSV files of transactions in which some lines lack a field or hold a word for the amount."""
    df = _txn(spark, sf_dir)
    fields = [F.col(c).cast("string") for c in TXN.names]
    amount = F.when(F.col(AMOUNT) < 10, F.lit("n/a")).otherwise(F.col(AMOUNT).cast("string"))
    short = F.concat_ws(",", *fields[:3])
    line = F.concat_ws(",", *fields[:-2], amount, fields[-1])
    # Each file starts with the names; a separator that no line holds leaves the lines as they are.
    body = df.select(F.when(F.col(TIME) < SHORT_BEFORE, short).otherwise(line).alias(",".join(TXN.names)))
    folder = shared_path(spark, "damaged")
    body.write.options(**CSV_WRITE, sep="\u0001").csv(folder)
    return folder


def _csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = read_checked(spark, _damaged(spark, sf_dir))
    short = F.size(F.split("line", ",")) == 3
    kinds = checked.rejected.select(F.when(short, "short").otherwise("no number").alias("kind"), "reason")
    accepted = checked.accepted.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(AMOUNT), 4).alias("amount"))
    return (
        kinds.groupBy("kind", "reason")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("amount", F.lit(None).cast("double"))
        .unionByName(accepted.select(F.lit("accepted").alias("kind"), F.lit(None).cast("string").alias("reason"), "rows", "amount"))
    )


def _csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "raw")
    write_table(_txn(spark, sf_dir).drop("txn_id"), path, fmt="csv")
    return profile.class_distribution(read_transactions(spark, path, "csv", schema=None))


def queries() -> dict[str, Query]:
    """One entry per operator; each reads whole tables below ``sf_dir``."""
    extra = {} if llm is None else {**llm.QUERIES, "pipeline": corpus_pipeline.run}
    return {**_queries(), **extra}


def _queries() -> dict[str, Query]:
    return {
        # counts and exploratory queries
        "row_count": _on(_txn, profile.row_count),
        "class_distribution": _study("class_distribution"),
        "rate_by_amount_bracket": _study("rate_by_amount_bracket"),
        "rate_by_hour": _study("rate_by_hour"),
        "class_means": _study("class_means"),
        "top_k_positive": _study("top_positive"),
        "rate_by_hour_events": _on(_events, lambda df: profile.rate_by_bucket(_hours(df), "hour")),
        "feature_means": _on(_txn, profile.feature_means),
        "rank_features": _on(_txn, profile.rank_features),
        # features
        "bucketize": _on(_txn, lambda df: features.bucketize(df).select("txn_id", AMOUNT, "bracket")),
        "hour_bucket": _on(_txn, lambda df: _hours(df).select("txn_id", TIME, "hour")),
        "log_amount": _on(
            _txn, lambda df: features.log1p(df).select("txn_id", F.round("Amount_log", 6).alias("Amount_log"))
        ),
        "interactions": _on(
            _txn,
            lambda df: features.interactions(df).select(
                "txn_id",
                *[F.round(c, 6).alias(c) for c in ("V14_x_V4", "V14_x_V12", "V4_x_V12")],
            ),
        ),
        "squares": _on(
            _txn, lambda df: features.squares(df).select("txn_id", F.round("V14_squared", 6).alias("V14_squared"))
        ),
        "valid_rows": _on(_txn, _valid_rows),
        "standardize": _on(_txn, _standardized),
        # weights and sampling
        "class_counts": _on(_txn, weights.class_counts),
        "class_weights": _on(_txn, lambda df: _rounded(weights.balanced(df))),
        "weighted_totals": _on(_txn, lambda df: _weighted_totals(weights.attach(df))),
        "positives": _on(_txn, lambda df: profile.positives(df).select("txn_id", LABEL)),
        "negatives": _on(_txn, lambda df: profile.negatives(df).select("txn_id", LABEL)),
        "oversample": _on(_txn, lambda df: sampling.oversample(df).select("txn_id", LABEL, "copy")),
        "replicate": _on(_txn, lambda df: sampling.replicate(df, 2).select("txn_id", LABEL, "copy")),
        "reweighted_after_oversample": _on(
            _txn, lambda df: _rounded(weights.balanced(sampling.oversample(df)))
        ),
        "hash_split": _on(_txn, lambda df: sampling.hash_split(df, "txn_id").select("txn_id", "is_train")),
        "hash_folds": _on(_txn, lambda df: sampling.hash_folds(df, "txn_id").select("txn_id", "fold")),
        "stratified_folds": _on(
            _txn, lambda df: sampling.stratified_folds(df, "txn_id").select("txn_id", "fold")
        ),
        "stratified_folds_events": _on(
            _events,
            lambda df: sampling.stratified_folds(df, "event_id")
            .groupBy("fold", LABEL)
            .agg(F.count(F.lit(1)).alias("n")),
        ),
        "hash_split_events": _on(
            _events,
            lambda df: sampling.hash_split(df, "event_id")
            .groupBy("is_train", LABEL)
            .agg(F.count(F.lit(1)).alias("n")),
        ),
        # evaluation on a deterministic score
        "scored": _on(_scored, lambda df: df.select("txn_id", LABEL, "score")),
        "decide": _on(_decided, lambda df: df.select("txn_id", "score", "prediction")),
        "confusion": _on(_decided, lambda df: evaluate.confusion(df).select("tp", "tn", "fp", "fn")),
        "detection_rates": _on(
            _decided, lambda df: evaluate.confusion(df).select("detection_rate_pct", "false_alarm_rate_pct")
        ),
        "weighted_prf": _on(_decided, lambda df: _rounded(evaluate.weighted_prf(df))),
        "positive_prf": _on(_decided, lambda df: _rounded(evaluate.positive_prf(df))),
        "roc_auc": _on(_scored, lambda df: _rounded(evaluate.roc_auc(df))),
        "pr_auc": _on(_scored, lambda df: _rounded(evaluate.pr_auc(df))),
        "ranking_events": _on(
            _events, lambda df: _rounded(evaluate.ranking(df, score=AMOUNT))
        ),
        "threshold_sweep": _on(_scored, lambda df: _rounded(evaluate.threshold_sweep(df))),
        "best_threshold": _on(
            _scored, lambda df: _rounded(evaluate.best_threshold(evaluate.threshold_sweep(df)))
        ),
        "final_decision": _on(_scored, _final_decision),
        "metrics_report": _on(_decided, lambda df: _rounded(evaluate.report(df))),
        "metrics_report_left_out": _on(_decided, lambda df: _rounded(evaluate.report(_left_out(df)))),
        "ranking_by_hour": _on(
            _scored, lambda df: _rounded(evaluate.ranking(_holed(df), by=["hour"]), 6)
        ),
        # drift
        "amount_drift": _on(
            _txn, lambda df: _rounded(drift.amount_drift(_hours(df), "hour", BASELINE_BUCKET), 6)
        ),
        "amount_drift_shifted": _on(
            _txn,
            lambda df: _rounded(
                drift.amount_drift(drift.shift_amount(_hours(df), "hour", 0.05), "hour", BASELINE_BUCKET), 6
            ),
        ),
        "amount_drift_holes": _on(
            _txn, lambda df: _rounded(drift.amount_drift(_holed(df), "hour", BASELINE_BUCKET), 6)
        ),
        "amount_drift_no_baseline": _on(
            _txn, lambda df: _rounded(drift.amount_drift(_holed(df), "hour", ABSENT_BUCKET), 6)
        ),
        "quality_drift": _on(_decided, lambda df: _rounded(drift.quality_drift(_hours(df), "hour"), 6)),
        "quality_drift_holes": _on(_decided, lambda df: _rounded(drift.quality_drift(_holed(df), "hour"), 6)),
        # sources and sinks
        "parquet_roundtrip": _parquet_roundtrip,
        "csv_roundtrip": _csv_roundtrip,
        "csv_inferred": _csv_inferred,
        "csv_rejects": _csv_rejects,
        "partitions_replaced": _partitions_replaced,
        # synthetic positives
        "smote": _on(_txn, _smote),
        "smote_events": _on(_events, _smote_events),
        "nearest_positives_events": _on(_events, _knn_events),
        # drift of rows that arrive in parts
        "amount_drift_loads": _amount_drift_loads,
        "quality_drift_loads": _quality_drift_loads,
        # models that SQL boosts as well
        "gbt_by_value": _gbt_by_value,
        "gbt_by_value_importances": _gbt_by_value_importances,
        "gbt_by_value_nodes": _gbt_by_value_nodes,
        "cv_by_value": _cv_by_value,
        "baseline_by_value": _baseline_by_value,
        "tuned_by_value_sweep": _tuned_by_value_sweep,
        "tuned_by_value_final": _tuned_by_value_final,
        # models
        "gbt_scored": _gbt_scored,
        "gbt_scored_positives": _gbt_scored_positives,
        "gbt_importances": _gbt_importances,
        "baseline_report": _baseline_report,
        "cv_metrics": _cv_metrics,
        "tuned_sweep": _tuned_sweep,
        "scaling": _scaling,
    }


# --- oracle ----------------------------------------------------------------

_V = ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS V{i}" for i in range(1, 29))

_TXN = f"""
WITH dated AS (
  SELECT *, datediff('day', TIMESTAMP '1995-01-01', CAST(l_shipdate AS TIMESTAMP)) AS days
  FROM lineitem
), txn AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, days) AS txn_id,
         CAST(days * 60 AS DOUBLE) AS "Time", {_V},
         l_extendedprice * l_discount AS Amount,
         CASE WHEN label = 0 AND l_returnflag = 'R' AND l_discount >= CAST(0.09 AS DOUBLE)
              THEN 1 ELSE 0 END AS Class
  FROM dated JOIN embeddings ON l_orderkey % (SELECT count(*) FROM embeddings) = vec_id
)"""

_EVENTS = """
WITH ev AS (
  SELECT event_id,
         CAST(floor(epoch(CAST(ts AS TIMESTAMP))) - epoch(TIMESTAMP '2024-01-01') AS BIGINT) AS "Time",
         value AS Amount, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS Class
  FROM events
)"""

_SCORED = _TXN + """, scored AS (
  SELECT *, round(1 / (1 + exp(-(V14 + V4 - Amount / 5000))), 6) AS score FROM txn
)"""

_DECIDED = _SCORED + """, decided AS (
  SELECT *, CASE WHEN score >= CAST(0.5 AS DOUBLE) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction
  FROM scored
)"""


def _cells(source: str, prediction: str = "prediction", by: str = "") -> str:
    head = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f""", cells AS (
  SELECT {head}count(*) FILTER (WHERE Class = 1 AND {prediction} = 1) AS tp,
         count(*) FILTER (WHERE Class = 0 AND {prediction} = 0) AS tn,
         count(*) FILTER (WHERE Class = 0 AND {prediction} = 1) AS fp,
         count(*) FILTER (WHERE Class = 1 AND {prediction} = 0) AS fn
  FROM {source}{tail}
)"""


_RATES = """round(tp * 100.0::DOUBLE / nullif(tp + fn, 0), 1) AS detection_rate_pct,
  round(fp * 100.0::DOUBLE / nullif(fp + tn, 0), 4) AS false_alarm_rate_pct"""

_PRF = """, prf AS (
  SELECT coalesce(tp / nullif(tp + fp, 0), 0) AS pp, coalesce(tp / nullif(tp + fn, 0), 0) AS pr,
         coalesce(tn / nullif(tn + fn, 0), 0) AS np, coalesce(tn / nullif(tn + fp, 0), 0) AS nr,
         tp + fn AS pos, tn + fp AS neg
  FROM cells
), f AS (
  SELECT *, coalesce(2 * pp * pr / nullif(pp + pr, 0), 0) AS pf,
            coalesce(2 * np * nr / nullif(np + nr, 0), 0) AS nf
  FROM prf
)"""


def _areas(source: str, score_col: str = "score", by: str = "") -> str:
    head = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f""", g AS (
  SELECT {head}{score_col} AS s, CAST(sum(Class) AS DOUBLE) AS p, CAST(sum(1 - Class) AS DOUBLE) AS n
  FROM {source} GROUP BY {head}{score_col}
), k AS (
  SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp,
         sum(p) OVER ({part}) AS pp, sum(n) OVER ({part}) AS nn
  FROM g WINDOW w AS ({part}ORDER BY s DESC ROWS UNBOUNDED PRECEDING)
), c AS (
  SELECT *, tp / (tp + fp) AS prec,
         lag(tp / (tp + fp)) OVER ({part}ORDER BY s DESC) AS prev
  FROM k
), areas AS (
  SELECT {head}sum(n * (2 * tp - p) / 2 / nullif(pp * nn, 0)) AS roc_auc,
         CASE WHEN max(nn) > 0
              THEN sum(p / nullif(pp, 0) * (prec + coalesce(prev, prec)) / 2) END AS pr_auc,
         CAST(max(pp) AS BIGINT) AS positives, CAST(max(nn) AS BIGINT) AS negatives
  FROM c{group}
)"""


_SWEEP = _SCORED + """, t AS (
  SELECT CAST(unnest([0.1, 0.2, 0.3, 0.4, 0.5]) AS DOUBLE) AS threshold
), counts AS (
  SELECT threshold,
         count(*) FILTER (WHERE Class = 1 AND score >= threshold) AS tp,
         count(*) FILTER (WHERE Class = 0 AND score >= threshold) AS fp,
         count(*) FILTER (WHERE Class = 1 AND score < threshold) AS fn,
         count(*) FILTER (WHERE Class = 0 AND score < threshold) AS tn
  FROM scored CROSS JOIN t GROUP BY threshold
), sweep AS (
  SELECT *, coalesce(round(tp * 100.0::DOUBLE / nullif(tp + fn, 0), 1), 0) AS caught_pct,
         coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
         coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1
  FROM counts
), best AS (
  SELECT threshold, f1 FROM (
    SELECT threshold, f1 FROM sweep WHERE f1 > 0
    UNION ALL SELECT 0.5::DOUBLE, 0.0::DOUBLE)
  ORDER BY f1 DESC, threshold LIMIT 1
)"""

_SLOT = "(('0x' || substr(md5({key}), 1, 8))::BIGINT) % {slots}"
_HOUR = 'CAST(floor("Time" / 3600) AS INTEGER) AS hour'
_BRACKET = """CASE WHEN {c} < 10 THEN 'Micro' WHEN {c} < 100 THEN 'Small'
  WHEN {c} < 500 THEN 'Medium' WHEN {c} < 1000 THEN 'Large' ELSE 'Very Large' END"""
_RATE = """count(*) AS total, CAST(sum(Class) AS BIGINT) AS fraud_count,
  round(sum(Class) / count(*) * 100, 4) AS fraud_rate_pct"""
_COPIES = "unnest(CASE WHEN Class = 1 THEN range(1, 11) ELSE [1] END)"

_MEANS = (
    _TXN
    + ", means AS ("
    + " UNION ALL ".join(
        f"SELECT '{v}' AS feature, avg({v}) FILTER (WHERE Class = 1) AS pos,"
        f" avg({v}) FILTER (WHERE Class = 0) AS neg FROM txn"
        for v in COMPONENTS
    )
    + """), gaps AS (
  SELECT feature, round(pos, 4) AS mean_pos, round(neg, 4) AS mean_neg,
         round(abs(pos - neg), 4) AS abs_diff FROM means
)"""
)


def _weights_sql(source: str) -> str:
    return f"""
  SELECT c.Class, c.n, round((SELECT count(*) FROM {source}) / (2.0::DOUBLE * nullif(c.n, 0)), 9) AS weight
  FROM (SELECT cls.Class, count(s.Class) AS n
        FROM (VALUES (0), (1)) cls(Class) LEFT JOIN {source} s USING (Class) GROUP BY cls.Class) c"""


def _psi_sql(amount: str, source: str = "hours", before: str = "", baseline_bucket: int = BASELINE_BUCKET) -> str:
    bins = range(5)
    step = f"CASE WHEN {amount} < 10 THEN 0 WHEN {amount} < 100 THEN 1 WHEN {amount} < 500 THEN 2 WHEN {amount} < 1000 THEN 3 WHEN {amount} IS NOT NULL THEN 4 END"
    counts = ", ".join(f"count(*) FILTER (WHERE bin = {i}) AS b{i}" for i in bins)
    share = "((c.b{i} + 0.5::DOUBLE) / (c.rows + 2.5::DOUBLE))"
    base = "((z.b{i} + 0.5::DOUBLE) / (z.rows + 2.5::DOUBLE))"
    terms = " + ".join(
        f"({share} - {base}) * ln({share} / {base})".replace("{i}", str(i)) for i in bins
    )
    hours = f", hours AS (SELECT *, {_HOUR} FROM txn)" if source == "hours" else ""
    return (
        _TXN
        + before
        + f"""{hours},
binned AS (SELECT hour, {step} AS bin FROM {source}),
c AS (SELECT hour, count(bin) AS rows, count(*) - count(bin) AS missing, {counts} FROM binned GROUP BY hour)
SELECT c.hour, c.rows, c.missing, CASE WHEN c.rows > 0 AND z.rows > 0 THEN round({terms}, 6) END AS psi
FROM c LEFT JOIN (SELECT * FROM c WHERE hour = {baseline_bucket}) z ON true"""
    )


def _quality_sql(source: str) -> str:
    return (
        _cells(source, by="hour")
        + _areas(source, by="hour")
        + f"""SELECT cells.hour, tp, tn, fp, fn, {_RATES},
             round(roc_auc, 6) AS roc_auc, CASE WHEN tp + fn > 0 THEN round(pr_auc, 6) END AS pr_auc
             FROM cells LEFT JOIN areas ON cells.hour IS NOT DISTINCT FROM areas.hour"""
    )


_SPLIT = _TXN + """, split AS (
  SELECT *, (('0x' || substr(md5(txn_id), 1, 8))::BIGINT) % 100 < 80 AS inside,
         (('0x' || substr(md5('validation:' || txn_id), 1, 8))::BIGINT) % 100 < 50 AS validates
  FROM txn
), test AS (SELECT * FROM split WHERE NOT inside)"""

#: The hash of ``stratified_folds`` and its rank among all keys of a class.
_DEALT = """, dealt AS (
  SELECT *, (dense_rank() OVER (PARTITION BY Class
         ORDER BY (('0x' || substr(md5('fold:' || {key}), 1, 8))::BIGINT) % 2147483648, {key}) - 1) % 3 AS fold
  FROM {source})"""


_HOLED = """, holed AS (
  SELECT txn_id, Class, {more}
         CASE WHEN hour <> 5 THEN hour END AS hour,
         CASE WHEN Amount >= 10 AND hour <> 7 THEN Amount END AS Amount
  FROM (SELECT *, CAST(floor("Time" / 3600) AS INTEGER) AS hour FROM {source}))"""


def _report_sql(source: str) -> str:
    usable = "Class IN (0, 1) AND score IS NOT NULL AND prediction IS NOT NULL"
    return (
        f", usable AS (SELECT * FROM {source} WHERE {usable})"
        + f""", lost AS (
  SELECT count(*) FILTER (WHERE ({usable}) IS NOT TRUE) AS left_out,
         count(*) FILTER (WHERE ({usable}) IS NOT TRUE AND Class = 1) AS left_out_positives
  FROM {source})"""
        + _cells("usable")
        + _PRF
        + _areas("usable")
        + " UNION ALL ".join(
            [
                *[_metric(c, c, "cells") for c in ("tp", "tn", "fp", "fn")],
                *[_metric(c, c, "lost") for c in ("left_out", "left_out_positives")],
                _metric("rows", "tp + tn + fp + fn", "cells"),
                _metric("detection_rate_pct", "round(tp * 100.0::DOUBLE / nullif(tp + fn, 0), 1)", "cells"),
                _metric("false_alarm_rate_pct", "round(fp * 100.0::DOUBLE / nullif(fp + tn, 0), 4)", "cells"),
                _metric("precision", "pp", "f"),
                _metric("recall", "pr", "f"),
                _metric("f1", "pf", "f"),
                _metric("weighted_precision", "(pos * pp + neg * np) / (pos + neg)", "f"),
                _metric("weighted_recall", "(pos * pr + neg * nr) / (pos + neg)", "f"),
                _metric("weighted_f1", "(pos * pf + neg * nf) / (pos + neg)", "f"),
                _metric("roc_auc", "roc_auc", "areas"),
                _metric("pr_auc", "pr_auc", "areas"),
            ]
        )
    )


_STATS = _TXN + """, stats AS MATERIALIZED (
  SELECT {moments} FROM txn)"""


def _standardize_sql(names: list[str]) -> str:
    moments = ", ".join(f'avg("{c}") AS m{i}, stddev_samp("{c}") AS s{i}' for i, c in enumerate(names))
    scaled = ", ".join(f'round(("{c}" - m{i}) / s{i}, 6) AS "{c}_std"' for i, c in enumerate(names))
    return _STATS.format(moments=moments) + f" SELECT txn_id, {scaled} FROM txn, stats"


def _cells_sql(copies: int = 1, stratified: bool = False) -> str:
    """Rows that agree in the four stepped features, label, fold and side, with their number and weight.

    Positives of the training side count ``copies`` times; classes are balanced on that side.
    """
    step = "CASE WHEN {c} < -0.1::DOUBLE THEN 0 WHEN {c} < 0 THEN 1 WHEN {c} < 0.1::DOUBLE THEN 2 ELSE 3 END"
    size = "CASE WHEN Amount < 10 THEN 0 WHEN Amount < 100 THEN 1 WHEN Amount < 500 THEN 2 WHEN Amount < 1000 THEN 3 ELSE 4 END"
    place = "(('0x' || substr(md5('fold:' || txn_id), 1, 8))::BIGINT)"
    rank = f"dense_rank() OVER (PARTITION BY side, y ORDER BY {place} % 2147483648, txn_id) - 1"
    return (
        _SPLIT
        + f""", sided AS (
  SELECT txn_id, Class AS y, CAST(floor("Time" / {3600 * STEP_HOURS}) AS INTEGER) AS f0, {size} AS f1,
         {step.format(c='V14')} AS f2, {step.format(c='V4')} AS f3,
         CASE WHEN inside THEN 'train' WHEN validates THEN 'validation' ELSE 'test' END AS side
  FROM split),
stepped AS (SELECT *, ({rank if stratified else place}) % 3 AS fold FROM sided)"""
        + f""", counted AS (
  SELECT f0, f1, f2, f3, y, fold, side, CAST(sum(CASE WHEN side = 'train' AND y = 1 THEN {copies} ELSE 1 END) AS BIGINT) AS n
  FROM stepped GROUP BY ALL)"""
    )


def _weighted_cells(learning: str) -> str:
    return f""", classes AS (
  SELECT y, (SELECT sum(n) FROM counted WHERE {learning}) / (2.0::DOUBLE * sum(n)) AS weight
  FROM counted WHERE {learning} GROUP BY y),
grouped AS (SELECT counted.*, n * weight AS w FROM counted JOIN classes USING (y))"""


def _boosted_sql(tag: str, inside: str, trees: int, depth: int, step: float) -> str:
    """Boost ``trees`` trees of ``depth`` levels on the cells ``inside``.

    ``<tag>_m<t>`` has all cells and their margin after ``t`` trees, ``<tag>_b<t>_<l>`` the splits of level ``l``.
    """
    sql = f""", {tag}_m0 AS (SELECT *, {inside} AS learns, 0.0::DOUBLE AS m FROM grouped),
{tag}_values AS (
  SELECT DISTINCT unnest([0, 1, 2, 3]) AS f, unnest([f0, f1, f2, f3]) AS v FROM {tag}_m0 WHERE learns)"""
    value = "CASE b.f WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END"
    for t in range(1, trees + 1):
        target = "2 * y - 1" if t == 1 else "4 * (2 * y - 1) / (1 + exp(2 * (2 * y - 1) * m))"
        sql += f""",
{tag}_r{t}_0 AS MATERIALIZED (SELECT *, CAST({target} AS DOUBLE) AS r, 1 AS node FROM {tag}_m{t - 1})"""
        for level in range(depth):
            at = f"{tag}_r{t}_{level}"
            sql += f""",
{at}_sums AS (
  SELECT node, f, v, sum(n) AS n, sum(w) AS w, sum(w * r) AS a, sum(w * r * r) AS q
  FROM (SELECT node, n, w, r, unnest([0, 1, 2, 3]) AS f, unnest([f0, f1, f2, f3]) AS v FROM {at} WHERE learns)
  GROUP BY ALL),
{at}_left AS (
  SELECT g.node, g.f, g.v, sum(coalesce(s.n, 0)) OVER l AS ln, sum(coalesce(s.w, 0)) OVER l AS lw,
         sum(coalesce(s.a, 0)) OVER l AS la, sum(coalesce(s.q, 0)) OVER l AS lq,
         tn, tw, ta, tq
  FROM (SELECT node, f, v FROM (SELECT DISTINCT node FROM {at}_sums), {tag}_values) g
  LEFT JOIN {at}_sums s USING (node, f, v)
  JOIN (SELECT node, sum(n) AS tn, sum(w) AS tw, sum(w * r) AS ta, sum(w * r * r) AS tq
        FROM {at} WHERE learns GROUP BY node) t USING (node)
  WINDOW l AS (PARTITION BY g.node, g.f ORDER BY g.v ROWS UNBOUNDED PRECEDING)),
{at}_gains AS (
  SELECT node, f, v, tw, (tq - ta * ta / tw) / tw - (lq - la * la / lw) / tw
         - ((tq - lq) - (ta - la) * (ta - la) / (tw - lw)) / tw AS gain
  FROM {at}_left WHERE ln > 0 AND ln < tn),
{tag}_b{t}_{level} AS MATERIALIZED (
  SELECT node, f, v, gain, tw FROM {at}_gains WHERE gain > 1e-12::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 12) DESC, f, v) = 1),
{tag}_r{t}_{level + 1} AS MATERIALIZED (
  SELECT r.* REPLACE (CASE WHEN b.f IS NULL THEN r.node ELSE 2 * r.node + CAST({value} > b.v AS INTEGER) END AS node)
  FROM {at} r LEFT JOIN {tag}_b{t}_{level} b ON b.node = r.node)"""
        rate = 1.0 if t == 1 else step
        sql += f""",
{tag}_leaf{t} AS (SELECT node, sum(w * r) / sum(w) AS leaf, sum(n) AS n FROM {tag}_r{t}_{depth} WHERE learns GROUP BY node),
{tag}_m{t} AS MATERIALIZED (
  SELECT r.* EXCLUDE (r, node) REPLACE (m + {rate}::DOUBLE * leaf AS m)
  FROM {tag}_r{t}_{depth} r JOIN {tag}_leaf{t} USING (node))"""
    return sql


def _by_value_sql(result: str) -> str:
    small = SMALL_TREES
    boosted = _boosted_sql("t", "true", small["maxIter"], small["maxDepth"], small["stepSize"])
    trees, levels = range(1, small["maxIter"] + 1), range(small["maxDepth"])
    splits = " UNION ALL ".join(f"SELECT {t} AS t, {lv} AS l, f, gain, tw FROM t_b{t}_{lv}" for t in trees for lv in levels)
    leaves = " UNION ALL ".join(f"SELECT {t} AS t, leaf, n FROM t_leaf{t}" for t in trees)
    rates = " UNION ALL ".join(f"SELECT {t} AS t, {1.0 if t == 1 else small['stepSize']}::DOUBLE AS rate" for t in trees)
    return _cells_sql() + _weighted_cells("true") + boosted + f""", splits AS ({splits}), leaves AS ({leaves}), rates AS ({rates}),
ends AS (SELECT f0, f1, f2, f3, max(1 / (1 + exp(-2 * m))) AS score FROM t_m{small['maxIter']} GROUP BY ALL)
{result}"""


def _search_sql(learning: str) -> str:
    """``means (trees, depth, metric)``: the mean PR area over the folds of the rows ``learning``."""
    sql, parts = "", []
    for i in range(3):
        for d in SMALL_GRID["maxDepth"]:
            name = f"k{i}d{d}"
            sql += _boosted_sql(
                name, f"{learning} AND fold <> {i}", max(SMALL_GRID["maxIter"]), d, SMALL_GRID["stepSize"][0]
            )
            parts += [
                f"SELECT {t} AS trees, {d} AS depth, fold, m, y, n FROM {name}_m{t} WHERE {learning} AND fold = {i}"
                for t in SMALL_GRID["maxIter"]
            ]
    return sql + f""", judged AS ({" UNION ALL ".join(parts)}),
g AS (
  SELECT trees, depth, fold, round(m, 10) AS s, CAST(sum(n * y) AS DOUBLE) AS p, CAST(sum(n * (1 - y)) AS DOUBLE) AS n
  FROM judged GROUP BY ALL),
k AS (
  SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY trees, depth, fold) AS pp
  FROM g WINDOW w AS (PARTITION BY trees, depth, fold ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
c AS (
  SELECT *, tp / (tp + fp) AS prec,
         lag(tp / (tp + fp)) OVER (PARTITION BY trees, depth, fold ORDER BY s DESC) AS prev
  FROM k),
areas AS (
  SELECT trees, depth, fold, sum(p / pp * (prec + coalesce(prev, prec)) / 2) AS area FROM c GROUP BY ALL),
means AS (SELECT trees, depth, avg(area) AS metric FROM areas GROUP BY ALL)"""


def _cv_by_value_sql() -> str:
    return _cells_sql() + _weighted_cells("true") + _search_sql("true") + """
SELECT CAST(trees AS INTEGER) AS "maxIter", CAST(depth AS INTEGER) AS "maxDepth", round(metric, 6) AS avg_metric,
  row_number() OVER (ORDER BY metric DESC, trees, depth) = 1 AS is_best FROM means"""


def _baseline_by_value_sql() -> str:
    """The baseline study: weights and trees of the training side, the report of the other."""
    trees = SMALL_TREES["maxIter"]
    boosted = _boosted_sql("t", "side = 'train'", trees, SMALL_TREES["maxDepth"], SMALL_TREES["stepSize"])
    report = _report_sql("judged").replace(", 9) AS value", ", 6) AS value")
    return _cells_sql() + _weighted_cells("side = 'train'") + boosted + f""", ends AS (
  SELECT f0, f1, f2, f3, round(max(1 / (1 + exp(-2 * m))), 12) AS score FROM t_m{trees} GROUP BY ALL),
judged AS (
  SELECT y AS Class, score, CASE WHEN score > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction
  FROM stepped JOIN ends USING (f0, f1, f2, f3) WHERE side <> 'train')""" + report


def _tuned_by_value_sql(result: str) -> str:
    """The tuned study: copies, even folds, the search, a refit, a threshold and the final decision."""
    train_side, rate = "side = 'train'", SMALL_GRID["stepSize"][0]
    sql = _cells_sql(OVERSAMPLING, stratified=True) + _weighted_cells(train_side) + _search_sql(train_side)
    finals = []
    for d in SMALL_GRID["maxDepth"]:
        sql += _boosted_sql(f"d{d}", train_side, max(SMALL_GRID["maxIter"]), d, rate)
        finals += [
            f"SELECT {t} AS trees, {d} AS depth, side, y, n, round(1 / (1 + exp(-2 * m)), 12) AS score FROM d{d}_m{t}"
            for t in SMALL_GRID["maxIter"]
        ]
    return sql + f""", chosen AS (SELECT trees, depth FROM means ORDER BY metric DESC, trees, depth LIMIT 1),
finals AS ({" UNION ALL ".join(finals)}),
model AS (SELECT * FROM finals JOIN chosen USING (trees, depth)),
t AS (SELECT CAST(unnest([0.1, 0.2, 0.3, 0.4, 0.5]) AS DOUBLE) AS threshold),
swept AS (
  SELECT threshold,
         coalesce(sum(n) FILTER (WHERE y = 1 AND score >= threshold), 0) AS tp,
         coalesce(sum(n) FILTER (WHERE y = 0 AND score >= threshold), 0) AS fp,
         coalesce(sum(n) FILTER (WHERE y = 1 AND score < threshold), 0) AS fn,
         coalesce(sum(n) FILTER (WHERE y = 0 AND score < threshold), 0) AS tn
  FROM model, t WHERE side = 'validation' GROUP BY threshold),
sweep AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM swept),
best AS (
  SELECT threshold FROM (
    SELECT threshold, f1 FROM sweep WHERE f1 > 0 UNION ALL SELECT 0.5::DOUBLE, 0.0::DOUBLE)
  ORDER BY f1 DESC, threshold LIMIT 1)
{result}"""


def _near_sql(source: str, key: str, features: list[str], k: int) -> str:
    """Every positive's ``k`` nearest others: all pairs, which is what the operator avoids."""
    squares = " + ".join(f'(a."{c}" - b."{c}") * (a."{c}" - b."{c}")' for c in features)
    cast = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in features)
    return f""", pos AS (SELECT CAST({key} AS VARCHAR) AS key, {cast} FROM {source} WHERE Class = 1),
met AS (
  SELECT a.key, b.key AS neighbour, {squares} AS d, row_number() OVER (PARTITION BY a.key ORDER BY {squares}, b.key) AS i
  FROM pos a JOIN pos b ON a.key <> b.key QUALIFY i <= {k})"""


def _smote_sql(source: str, key: str, features: list[str], k: int, factor: int) -> str:
    slot = "(('0x' || substr(md5('smote:{what}:' || key || '-' || copy), 1, 8))::BIGINT) % 2147483648"
    between = ", ".join(f'round(x."{c}" + way * (y."{c}" - x."{c}"), 6) AS "{c}"' for c in features)
    return _near_sql(source, key, features, k) + f""",
sized AS (SELECT key, count(*) AS held FROM met GROUP BY key),
copies AS (SELECT key, held, CAST(unnest(range(2, {factor + 1})) AS INTEGER) AS copy FROM sized),
placed AS (
  SELECT key, copy, {slot.format(what='pick')} % held + 1 AS i, ({slot.format(what='way')}) / 2147483648.0::DOUBLE AS way
  FROM copies)
SELECT p.key AS {key}, p.copy, m.neighbour, {between}, 1::INTEGER AS Class
FROM placed p JOIN met m ON m.key = p.key AND m.i = p.i JOIN pos x ON x.key = p.key JOIN pos y ON y.key = m.neighbour"""


def _metric(name: str, value: str, source: str) -> str:
    return f"SELECT '{name}' AS metric, round(CAST({value} AS DOUBLE), 9) AS value FROM {source}"


def oracle_sql() -> dict[str, str]:
    """The same results in DuckDB SQL, for every query that SQL can express."""
    extra = {} if llm is None else dict(llm.ORACLE_SQL)
    if llm is not None and corpus_pipeline.ORACLE_SQL:
        extra["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**_oracle_sql(), **extra}


def _oracle_sql() -> dict[str, str]:
    hour_rates = f"SELECT hour, {_RATE} FROM (SELECT *, {_HOUR} FROM txn) GROUP BY hour"
    class_distribution = """SELECT Class, count(*) AS count, round(avg(Amount), 2) AS avg_amount,
      round(min(Amount), 2) AS min_amount, round(max(Amount), 2) AS max_amount
      FROM txn GROUP BY Class"""
    return {
        "row_count": _TXN + "SELECT count(*) AS rows FROM txn",
        "class_distribution": _TXN + class_distribution,
        "rate_by_amount_bracket": _TXN
        + f"""SELECT bracket, {_RATE}, round(avg(Amount), 2) AS avg_amount
              FROM (SELECT *, {_BRACKET.format(c='Amount')} AS bracket FROM txn) GROUP BY bracket""",
        "rate_by_hour": _TXN + hour_rates,
        "class_means": _TXN
        + "SELECT Class, "
        + ", ".join(f"round(avg(V{i}), 4) AS V{i}" for i in range(1, 6))
        + ", round(avg(Amount), 2) AS avg_amount FROM txn GROUP BY Class",
        "top_k_positive": _TXN
        + """SELECT txn_id, "Time", Amount, V1, V2, V3, Class FROM txn WHERE Class = 1
             ORDER BY Amount DESC, txn_id LIMIT 10""",
        "rate_by_hour_events": _EVENTS
        + f"SELECT hour, {_RATE} FROM (SELECT *, {_HOUR} FROM ev) GROUP BY hour",
        "feature_means": _MEANS + "SELECT * FROM gaps",
        "rank_features": _MEANS + "SELECT * FROM gaps ORDER BY abs_diff DESC, feature LIMIT 10",
        "bucketize": _TXN + f"SELECT txn_id, Amount, {_BRACKET.format(c='Amount')} AS bracket FROM txn",
        "hour_bucket": _TXN + f'SELECT txn_id, "Time", {_HOUR} FROM txn',
        "log_amount": _TXN + "SELECT txn_id, round(ln(Amount + 1), 6) AS Amount_log FROM txn",
        "interactions": _TXN
        + """SELECT txn_id, round(V14 * V4, 6) AS V14_x_V4, round(V14 * V12, 6) AS V14_x_V12,
             round(V4 * V12, 6) AS V4_x_V12 FROM txn""",
        "squares": _TXN + "SELECT txn_id, round(V14 * V14, 6) AS V14_squared FROM txn",
        "valid_rows": _TXN
        + "SELECT txn_id, Amount FROM txn WHERE Amount >= 10 AND V1 <= CAST(0.3 AS DOUBLE)",
        "standardize": _standardize_sql([TIME, "V1", "V14", AMOUNT]),
        "class_counts": _TXN
        + """SELECT cls.Class, count(txn.Class) AS n,
             round(count(txn.Class) / (SELECT count(*) FROM txn) * 100, 4) AS pct
             FROM (VALUES (0), (1)) cls(Class) LEFT JOIN txn USING (Class) GROUP BY cls.Class""",
        "class_weights": _TXN + _weights_sql("txn"),
        "weighted_totals": _TXN
        + f""", w AS ({_weights_sql('txn')})
             SELECT txn.Class, count(*) AS n, round(count(*) * max((SELECT count(*) FROM txn) / (2.0::DOUBLE * w.n)), 6)
             AS weight_sum FROM txn JOIN w USING (Class) GROUP BY txn.Class""",
        "positives": _TXN + "SELECT txn_id, Class FROM txn WHERE Class = 1",
        "negatives": _TXN + "SELECT txn_id, Class FROM txn WHERE Class = 0",
        "oversample": _TXN + f"SELECT txn_id, Class, CAST({_COPIES} AS INTEGER) AS copy FROM txn",
        "replicate": _TXN + "SELECT txn_id, Class, CAST(unnest([1, 2]) AS INTEGER) AS copy FROM txn",
        "reweighted_after_oversample": _TXN
        + f", copies AS (SELECT Class, {_COPIES} AS copy FROM txn) "
        + _weights_sql("copies"),
        "hash_split": _TXN
        + f"SELECT txn_id, {_SLOT.format(key='txn_id', slots=100)} < 80 AS is_train FROM txn",
        "hash_folds": _TXN
        + "SELECT txn_id, CAST("
        + _SLOT.format(key="'fold:' || txn_id", slots=3)
        + " AS INTEGER) AS fold FROM txn",
        "hash_split_events": _EVENTS
        + f"""SELECT {_SLOT.format(key='CAST(event_id AS VARCHAR)', slots=100)} < 80 AS is_train,
              Class, count(*) AS n FROM ev GROUP BY ALL""",
        "scored": _SCORED + "SELECT txn_id, Class, score FROM scored",
        "decide": _DECIDED + "SELECT txn_id, score, prediction FROM decided",
        "confusion": _DECIDED + _cells("decided") + "SELECT * FROM cells",
        "detection_rates": _DECIDED + _cells("decided") + f"SELECT {_RATES} FROM cells",
        "weighted_prf": _DECIDED
        + _cells("decided")
        + _PRF
        + """SELECT round((pos * pp + neg * np) / (pos + neg), 9) AS weighted_precision,
             round((pos * pr + neg * nr) / (pos + neg), 9) AS weighted_recall,
             round((pos * pf + neg * nf) / (pos + neg), 9) AS weighted_f1 FROM f""",
        "positive_prf": _DECIDED
        + _cells("decided")
        + _PRF
        + "SELECT round(pp, 9) AS precision, round(pr, 9) AS recall, round(pf, 9) AS f1 FROM f",
        "roc_auc": _SCORED + _areas("scored") + "SELECT round(roc_auc, 9) AS roc_auc FROM areas",
        "pr_auc": _SCORED + _areas("scored") + "SELECT round(pr_auc, 9) AS pr_auc FROM areas",
        "ranking_events": _EVENTS
        + _areas("ev", "Amount")
        + """SELECT round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc,
             positives, negatives FROM areas""",
        "threshold_sweep": _SWEEP
        + """SELECT threshold, tp, fp, fn, tn, caught_pct, round(precision, 9) AS precision,
             round(recall, 9) AS recall, round(f1, 9) AS f1 FROM sweep""",
        "best_threshold": _SWEEP + "SELECT threshold, round(f1, 9) AS f1 FROM best",
        "final_decision": _SWEEP
        + """, final AS (
             SELECT Class, CASE WHEN score >= (SELECT threshold FROM best) THEN 1 ELSE 0 END AS decision
             FROM scored)"""
        + _cells("final", "decision")
        + f"SELECT tp, tn, fp, fn, {_RATES} FROM cells",
        "metrics_report": _DECIDED + _report_sql("decided"),
        "metrics_report_left_out": _DECIDED
        + """, lacking AS (
  SELECT CASE WHEN Amount >= 5 THEN Class END AS Class, CASE WHEN V1 < 0.2::DOUBLE THEN score END AS score,
         prediction FROM decided)"""
        + _report_sql("lacking"),
        "ranking_by_hour": _SCORED
        + _HOLED.format(source="scored", more="score,")
        + _areas("holed", by="hour")
        + """SELECT hour, round(roc_auc, 6) AS roc_auc, CASE WHEN positives > 0 THEN round(pr_auc, 6) END AS pr_auc,
             positives, negatives FROM areas""",
        "amount_drift": _psi_sql("Amount"),
        "amount_drift_shifted": _psi_sql("(Amount * (1 + 0.05::DOUBLE * hour))"),
        "amount_drift_holes": _psi_sql("Amount", "holed", _HOLED.format(source="txn", more="")),
        "amount_drift_no_baseline": _psi_sql(
            "Amount", "holed", _HOLED.format(source="txn", more=""), ABSENT_BUCKET
        ),
        "quality_drift": _DECIDED
        + f", hours AS (SELECT *, {_HOUR} FROM decided)"
        + _quality_sql("hours"),
        "quality_drift_holes": _DECIDED
        + _HOLED.format(source="decided", more="score, prediction,")
        + _quality_sql("holed"),
        "stratified_folds": _TXN
        + _DEALT.format(source="txn", key="txn_id")
        + "SELECT txn_id, CAST(fold AS INTEGER) AS fold FROM dealt",
        "stratified_folds_events": _EVENTS
        + _DEALT.format(source="ev", key="CAST(event_id AS VARCHAR)")
        + "SELECT CAST(fold AS INTEGER) AS fold, Class, count(*) AS n FROM dealt GROUP BY ALL",
        # Models are fitted in full; SQL fixes what any fit must satisfy.
        "gbt_scored": _SPLIT
        + "SELECT txn_id, Class, Amount, true AS is_probability, true AS decides_by_half FROM test",
        "gbt_scored_positives": _SPLIT
        + """SELECT txn_id, Class, true AS prediction, Amount FROM test WHERE Class = 1
             ORDER BY Amount DESC, txn_id LIMIT 10""",
        "gbt_importances": """SELECT 30::BIGINT AS n, true AS sums_to_one, true AS none_negative, true AS ranked""",
        "baseline_report": _SPLIT
        + """SELECT CAST(count(*) AS DOUBLE) AS rows, CAST(sum(Class) AS DOUBLE) AS positives,
             CAST(sum(1 - Class) AS DOUBLE) AS negatives, 0.0::DOUBLE AS left_out FROM test""",
        "cv_metrics": """SELECT CAST(i AS DOUBLE) AS "maxIter", CAST(d AS DOUBLE) AS "maxDepth",
             CAST(s AS DOUBLE) AS "stepSize", 1::BIGINT AS best_settings, true AS best_is_largest
             FROM (VALUES (50), (100)) a(i), (VALUES (4), (6)) b(d), (VALUES (0.05), (0.1)) c(s)""",
        "tuned_sweep": _SPLIT
        + """SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(sum(Class) AS BIGINT) AS positives,
             CAST(sum(1 - Class) AS BIGINT) AS negatives
             FROM test, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]) AS threshold)
             WHERE validates GROUP BY threshold""",
        "scaling": _SPLIT
        + """SELECT CAST(times AS INTEGER) AS multiplier, count(*) * times AS rows,
             count(*) FILTER (WHERE inside) * times AS train_rows, true AS is_area
             FROM split, (SELECT unnest([1, 2, 5, 10]) AS times) GROUP BY times""",
        "parquet_roundtrip": _TXN + hour_rates,
        "csv_roundtrip": _TXN + class_distribution,
        "csv_inferred": _TXN + class_distribution,
        "csv_rejects": _TXN
        + f""", kinds AS (
  SELECT CASE WHEN "Time" < {SHORT_BEFORE} THEN 'short' WHEN Amount < 10 THEN 'no number' ELSE 'accepted' END AS kind, Amount FROM txn)
SELECT kind, CASE WHEN kind <> 'accepted' THEN 'malformed' END AS reason, count(*) AS rows,
  CASE WHEN kind = 'accepted' THEN round(sum(Amount), 4) END AS amount FROM kinds GROUP BY kind""",
        "partitions_replaced": _TXN
        + f"""SELECT hour, count(*) AS rows, round(sum(Amount), 4) AS amount, CAST(sum(Class) AS BIGINT) AS positives
              FROM (SELECT *, {_HOUR} FROM txn) GROUP BY hour""",
        "smote": _TXN + _smote_sql("txn", "txn_id", BASE_FEATURES, 5, 10),
        "smote_events": _EVENTS + _smote_sql("ev", "event_id", [TIME, AMOUNT], 3, 3),
        "nearest_positives_events": _EVENTS
        + _near_sql("ev", "event_id", [TIME, AMOUNT], 5)
        + """SELECT key AS event_id, CAST(i - 1 AS INTEGER) AS rank, neighbour,
             round(d, 6) AS squared_distance FROM met""",
        "amount_drift_loads": _psi_sql("Amount"),
        "quality_drift_loads": _DECIDED
        + f", hours AS (SELECT *, {_HOUR} FROM decided)"
        + _quality_sql("hours"),
        "gbt_by_value": _by_value_sql(
            """SELECT txn_id, round(score, 6) AS score, CASE WHEN score > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
               AS prediction FROM stepped JOIN ends USING (f0, f1, f2, f3)"""
        ),
        "gbt_by_value_importances": _by_value_sql(
            f""", names AS (SELECT unnest({list(STEPS)!r}) AS feature, unnest([0, 1, 2, 3]) AS f),
shares AS (SELECT feature, coalesce(sum(gain * tw), 0) / (SELECT sum(gain * tw) FROM splits) AS share
  FROM names LEFT JOIN splits USING (f) GROUP BY feature)
SELECT feature, round(share, 6) AS importance,
  CAST(row_number() OVER (ORDER BY share DESC, feature) AS INTEGER) AS rank FROM shares"""
        ),
        "gbt_by_value_nodes": _by_value_sql(
            """SELECT CAST(t - 1 AS INTEGER) AS tree, CAST((SELECT count(*) FROM splits s WHERE s.t = e.t) AS BIGINT) AS splits,
               CAST(sum(n) AS BIGINT) AS rows, round((SELECT rate FROM rates x WHERE x.t = e.t), 6) AS weight,
               round(max(leaf), 6) AS largest,
               round((SELECT gain FROM splits s WHERE s.t = e.t AND l = 0), 6) AS first_gain
               FROM leaves e GROUP BY t"""
        ),
        "cv_by_value": _cv_by_value_sql(),
        "baseline_by_value": _baseline_by_value_sql(),
        "tuned_by_value_sweep": _tuned_by_value_sql(
            """SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
               CAST(tn AS BIGINT) AS tn, round(f1, 6) AS f1 FROM sweep"""
        ),
        "tuned_by_value_final": _tuned_by_value_sql(
            """, decided AS (
  SELECT CAST(coalesce(sum(n) FILTER (WHERE y = 1 AND score >= threshold), 0) AS BIGINT) AS tp,
         CAST(coalesce(sum(n) FILTER (WHERE y = 0 AND score < threshold), 0) AS BIGINT) AS tn,
         CAST(coalesce(sum(n) FILTER (WHERE y = 0 AND score >= threshold), 0) AS BIGINT) AS fp,
         CAST(coalesce(sum(n) FILTER (WHERE y = 1 AND score < threshold), 0) AS BIGINT) AS fn
  FROM model, best WHERE side = 'test')
SELECT CAST(trees AS INTEGER) AS "maxIter", CAST(depth AS INTEGER) AS "maxDepth", threshold, tp, tn, fp, fn, """
            + _RATES
            + " FROM decided, chosen, best"
        ),
    }
