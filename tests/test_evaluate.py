import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from riskframe.operators import evaluate
from riskframe.operators.score import decide


def table(spark, pairs):
    return spark.createDataFrame(pairs, "Class int, score double")


def areas_by_hand(pairs):
    """Trapezoids between the points at every distinct score."""
    pos = sum(1 for y, _ in pairs if y == 1)
    neg = len(pairs) - pos
    if not pos or not neg:
        return None, None
    roc = pr = 0.0
    tp = fp = 0
    last = None
    for s in sorted({s for _, s in pairs}, reverse=True):
        p = sum(1 for y, v in pairs if v == s and y == 1)
        n = sum(1 for y, v in pairs if v == s and y == 0)
        roc += n / neg * (tp + p / 2) / pos
        tp, fp = tp + p, fp + n
        precision = tp / (tp + fp)
        pr += p / pos * (precision + (precision if last is None else last)) / 2
        last = precision
    return roc, pr


PAIRS = st.lists(
    st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.1, 0.2, 0.25, 0.5, 0.7, 0.9, 1.0, -3.0, 8.5])),
    max_size=40,
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(pairs=PAIRS, ranges=st.sampled_from([1, 2, 5]))
def test_ranking_equals_brute_force_for_any_cut(spark, pairs, ranges):
    row = evaluate.ranking(table(spark, pairs), ranges=ranges).first()
    roc, pr = areas_by_hand(pairs)
    assert row["roc_auc"] == (None if roc is None else pytest.approx(roc))
    assert row["pr_auc"] == (None if pr is None else pytest.approx(pr))
    assert (row["positives"], row["negatives"]) == (
        sum(y for y, _ in pairs), sum(1 - y for y, _ in pairs)
    )


def test_ranking_agrees_with_the_ml_evaluator(scored):
    row = evaluate.ranking(scored).first()
    for metric, field in (("areaUnderROC", "roc_auc"), ("areaUnderPR", "pr_auc")):
        judge = BinaryClassificationEvaluator(
            labelCol="Class", rawPredictionCol="score", metricName=metric, numBins=0
        )
        assert row[field] == pytest.approx(judge.evaluate(scored), abs=1e-12)


@pytest.mark.parametrize(
    "pairs, roc",
    [
        ([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], 1.0),
        ([(0, 0.9), (0, 0.8), (1, 0.2), (1, 0.1)], 0.0),
        ([(0, 0.5), (1, 0.5), (0, 0.5)], 0.5),
        ([(1, 0.5), (1, 0.4)], None),
        ([], None),
    ],
)
def test_ranking_edge_cases(spark, pairs, roc):
    assert evaluate.roc_auc(table(spark, pairs)).first()["roc_auc"] == roc


def test_ranking_with_a_hot_score_and_missing_values(spark):
    hot = spark.range(3000).select((F.col("id") % 50 == 0).cast("int").alias("Class"), F.lit(0.25).alias("score"))
    rest = spark.range(6000).select(
        (F.col("id") % 7 == 0).cast("int").alias("Class"), (F.col("id") / 6000).alias("score")
    )
    unusable = table(spark, [(None, 0.3), (1, None)])
    df = hot.unionByName(rest).unionByName(unusable)
    expected = areas_by_hand([(r[0], r[1]) for r in hot.unionByName(rest).collect()])
    row = evaluate.ranking(df, ranges=16).first()
    assert (row["roc_auc"], row["pr_auc"]) == pytest.approx(expected)


def test_ranking_per_group_equals_separate_runs(scored):
    grouped = scored.withColumn("g", F.length("txn_id") % 3)
    for row in evaluate.ranking(grouped, by=["g"]).collect():
        alone = evaluate.ranking(grouped.filter(F.col("g") == row["g"])).first()
        for c in ("roc_auc", "pr_auc"):
            assert row[c] == (None if alone[c] is None else pytest.approx(alone[c]))
        assert (row["positives"], row["negatives"]) == (alone["positives"], alone["negatives"])


def test_bins_approximate_the_exact_area(scored):
    exact = evaluate.ranking(scored).first()
    rough = evaluate.ranking(scored, bins=1000).first()
    assert rough["roc_auc"] == pytest.approx(exact["roc_auc"], abs=0.01)


def test_confusion_cells_add_up(scored):
    row = evaluate.confusion(decide(scored, 0.5, out="prediction")).first()
    assert row["tp"] + row["tn"] + row["fp"] + row["fn"] == scored.count()


def test_rates_are_null_without_rows_to_divide_by(spark):
    df = spark.createDataFrame([(0, 0.0)], "Class int, prediction double")
    row = evaluate.confusion(df).first()
    assert row["detection_rate_pct"] is None and row["false_alarm_rate_pct"] == 0.0
    assert tuple(evaluate.positive_prf(df).first()) == (0.0, 0.0, 0.0)
    assert tuple(evaluate.weighted_prf(df.limit(0)).first()) == (None, None, None)


def test_weighted_scores_agree_with_the_ml_evaluator(scored):
    df = decide(scored, 0.4, out="prediction")
    row = evaluate.weighted_prf(df).first()
    for metric, field in (
        ("weightedPrecision", "weighted_precision"), ("weightedRecall", "weighted_recall"), ("f1", "weighted_f1")
    ):
        judge = MulticlassClassificationEvaluator(labelCol="Class", predictionCol="prediction", metricName=metric)
        assert row[field] == pytest.approx(judge.evaluate(df), abs=1e-12)


def test_sweep_agrees_with_one_confusion_per_threshold(scored):
    sweep = {r["threshold"]: r for r in evaluate.threshold_sweep(scored).collect()}
    assert sorted(sweep) == [0.1, 0.2, 0.3, 0.4, 0.5]
    for t, row in sweep.items():
        cells = evaluate.confusion(decide(scored, t, out="prediction")).first()
        assert [row[c] for c in ("tp", "tn", "fp", "fn")] == [cells[c] for c in ("tp", "tn", "fp", "fn")]
    ordered = [sweep[t] for t in sorted(sweep)]
    for a, b in zip(ordered, ordered[1:]):
        assert a["tp"] >= b["tp"] and a["fp"] >= b["fp"]


def test_a_score_on_the_threshold_counts_as_positive(spark):
    df = table(spark, [(1, 0.1), (1, 0.3), (0, 0.5), (0, 0.05)])
    sweep = {r["threshold"]: (r["tp"], r["fp"]) for r in evaluate.threshold_sweep(df).collect()}
    assert sweep == {0.1: (2, 1), 0.2: (1, 1), 0.3: (1, 1), 0.4: (0, 1), 0.5: (0, 1)}


def test_sweep_of_nothing_has_all_thresholds(spark):
    out = evaluate.threshold_sweep(table(spark, []))
    assert {(r["threshold"], r["tp"], r["f1"]) for r in out.collect()} == {(t / 10, 0, 0.0) for t in range(1, 6)}


def test_best_threshold_prefers_the_lowest_on_ties_and_falls_back(spark):
    tied = evaluate.threshold_sweep(table(spark, [(1, 0.9), (0, 0.01)]))
    assert evaluate.best_threshold(tied).first()["threshold"] == 0.1
    none = evaluate.threshold_sweep(table(spark, [(1, 0.0), (0, 0.9)]))
    assert tuple(evaluate.best_threshold(none).first()) == (0.5, 0.0)


def test_decide_keeps_null_and_takes_a_subquery(spark):
    df = table(spark, [(1, 0.2), (1, None), (0, 0.1)])
    assert [r["decision"] for r in decide(df, 0.2).collect()] == [1.0, None, 0.0]
    cut = spark.range(1).select(F.lit(0.15).alias("t")).scalar()
    assert [r["decision"] for r in decide(df, cut).collect()] == [1.0, None, 0.0]


def test_report_names_every_metric_once(scored):
    out = evaluate.report(decide(scored, 0.5, out="prediction")).collect()
    names = [r["metric"] for r in out]
    assert len(names) == len(set(names)) == 17
    assert {r["metric"]: r["value"] for r in out}["rows"] == scored.count()


def test_tied_rows_do_not_fill_a_range(spark):
    tied = spark.range(99_000).select((F.col("id") % 3 == 0).cast("int").alias("Class"), F.lit(0.001).alias("score"))
    rest = spark.range(1_000).select((F.col("id") % 2).cast("int").alias("Class"), (F.col("id") / 1000).alias("score"))
    groups = tied.unionByName(rest).select(F.col("score").alias("s")).distinct()
    edges = evaluate._range_edges(groups, "s", 20)
    sizes = [sum(1 for i in range(1000) if a <= i / 1000 < b) for a, b in zip([-1.0, *edges], [*edges, 2.0])]
    assert len(edges) >= 15 and max(sizes) <= 3 * 1000 / 20


def test_ranking_keeps_the_null_group(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.1), (None, 1, 0.2), (None, 0, 0.8)]
    df = spark.createDataFrame(rows, "g string, Class int, score double")
    got = {r["g"]: r["roc_auc"] for r in evaluate.ranking(df, by=["g"]).collect()}
    assert got == {"a": 1.0, None: 0.0}


def test_report_counts_what_it_leaves_out(spark):
    rows = [(1, 0.9, 1.0), (0, 0.1, 0.0), (1, None, 1.0), (None, 0.3, 0.0), (0, 0.2, None)]
    df = spark.createDataFrame(rows, "Class int, score double, prediction double")
    got = {r["metric"]: r["value"] for r in evaluate.report(df).collect()}
    assert (got["rows"], got["left_out"], got["left_out_positives"]) == (2, 3, 1)
