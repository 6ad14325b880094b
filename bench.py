"""Headline timings: prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.
The full tuning grid (25 fits of 50 to 100 trees) runs on the tables of
``BENCH_CV_DIR``, by default those of sf0.01 beside them (60,000 rows), since it
takes minutes there; its rows are in the output.  ``stages`` has, for every query,
the number of its stages, the seconds of all its tasks, what it shuffled and
spilled, and its three longest stages, from Spark's event log.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager

from riskframe.operators import drift, evaluate, features, profile, sampling, synthetic, weights
from riskframe.operators.score import decide
from riskframe.plans.baseline import baseline
from riskframe.plans.explore import explore
from riskframe.plans.scaling import scaling, timed
from riskframe.plans.stages import LOG_SETTINGS, named, query_times, stage_times
from riskframe.plans.tuned import tuned
from riskframe.session import local_session, shared_path
from riskframe.sources import fixtures
from riskframe.sources.schema import BASE_FEATURES, COMPONENTS
from riskframe.sources.tables import write_table


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    settings = {**LOG_SETTINGS, "spark.eventLog.dir": f"file://{tempfile.mkdtemp(prefix='bench-events-')}"}
    spark = local_session(cpus, "bench", **{k.replace(".", "__"): v for k, v in settings.items()})
    seconds: dict[str, float] = {}

    @contextmanager
    def measured(name: str) -> Iterator[None]:
        start = time.perf_counter()
        with named(spark, name):
            yield
        seconds[name] = time.perf_counter() - start

    # The reference's table is stored before its scripts run; so is this one.
    with measured("load"):
        df = write_table(fixtures.txn(spark, sf_dir).repartition(cpus), shared_path(spark, "txn"))
    rows = df.count()

    raw = write_table(df.drop("txn_id"), shared_path(spark, "raw"), fmt="csv")
    with measured("scan_csv"):
        timed(raw)

    explored = explore(df, ["txn_id"])
    for name, table in explored.items():
        with measured(name):
            timed(table)
    seconds["explore_total"] = sum(seconds[name] for name in explored)

    scored = fixtures.scored(df)
    decided = decide(scored, 0.5, out="prediction")
    hours = features.hour_bucket(decided)
    state = drift.DriftState(spark, shared_path(spark, "drift"), "hour")
    lazy = {
        "feature_means": lambda: profile.feature_means(df),
        "engineered": lambda: features.engineered(df),
        "standardize": lambda: features.standardize(df, COMPONENTS),
        "class_weights": lambda: weights.attach(df),
        "oversample": lambda: sampling.oversample(df),
        "replicate_10x": lambda: sampling.replicate(df, 10),
        "hash_split": lambda: sampling.hash_split(df, "txn_id"),
        "hash_folds": lambda: sampling.hash_folds(df, "txn_id"),
        "stratified_folds": lambda: sampling.stratified_folds(df, "txn_id"),
        "smote": lambda: synthetic.smote(df, "txn_id", BASE_FEATURES),
        "confusion": lambda: evaluate.confusion(decided),
        "ranking": lambda: evaluate.ranking(scored),
        "threshold_sweep": lambda: evaluate.threshold_sweep(scored),
        "report": lambda: evaluate.report(decided),
        "amount_drift": lambda: drift.amount_drift(hours, "hour", 0),
        "quality_drift": lambda: drift.quality_drift(hours, "hour"),
    }
    for name, query in lazy.items():
        with measured(name):
            timed(query())
    with measured("drift_load"):
        state.load(hours, "all")

    with measured("baseline_50_trees"):
        baseline(df, "txn_id").report.collect()

    with named(spark, "scaling"):
        curve = scaling(df, "txn_id").collect()
    for row in curve:
        seconds[f"train_{row['multiplier']}x"] = row["train_seconds"]

    cv_dir = os.environ.get("BENCH_CV_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01"))
    searched = write_table(fixtures.txn(spark, cv_dir).repartition(cpus), shared_path(spark, "txn"))
    with measured("search_8_settings"):
        tuned(searched, "txn_id", parallelism=cpus, partitions=max(1, cpus // 4)).report.collect()
    stages = {
        r["query"]: {
            "stages": r["stages"],
            "task_seconds": r["task_seconds"],
            "shuffle_mb": r["shuffle_write_mb"],
            "spill_mb": r["spill_mb"],
            "longest": [[s["stage"], s["seconds"]] for s in r["longest"]],
        }
        for r in query_times(stage_times(spark)).filter("query is not null").collect()
    }

    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(v for k, v in seconds.items() if k != "explore_total"), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "rows": rows,
                "search_rows": searched.count(),
                "cpus": cpus,
                "stages": stages,
                "scaling": [
                    {
                        "multiplier": r["multiplier"],
                        "rows": r["rows"],
                        "train_rows_per_sec": round(r["train_rows"] / r["train_seconds"]),
                        "roc_auc": round(r["roc_auc"], 4),
                    }
                    for r in curve
                ],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
