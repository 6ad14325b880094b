import duckdb
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.functions.columns import positive_probability
from riskframe.operators import boost, drift, evaluate, features, sampling, train, weights
from riskframe.operators.score import decide, score
from riskframe.plans.baseline import baseline
from riskframe.plans.explore import explore
from riskframe.plans.scaling import scaling, timed
from riskframe.plans.tuned import prepared, tuned
from riskframe.session import own_tables
from riskframe.sources.schema import BASE_FEATURES, ENGINEERED_FEATURES, TUNING_GRID

TINY = {"maxIter": 3, "maxDepth": 3}


@pytest.fixture(scope="module")
def study(txn):
    return baseline(txn, "txn_id", params=TINY, keep=["txn_id"])


def test_feature_lists_have_the_published_lengths():
    assert len(BASE_FEATURES) == 30 and len(ENGINEERED_FEATURES) == 34


def test_baseline_scores_every_test_row_with_scalars_only(txn, study):
    _, test = sampling.train_test(txn, "txn_id")
    assert study.scored.count() == test.count()
    assert dict(study.scored.dtypes) == {
        "txn_id": "string", "Class": "int", "score": "double", "prediction": "double"
    }
    assert study.scored.filter("score < 0 or score > 1").count() == 0
    values = {r["metric"]: r["value"] for r in study.report.collect()}
    assert values["rows"] == test.count() and 0 <= values["roc_auc"] <= 1


def test_importances_sum_to_one_and_are_ranked(study):
    rows = study.importances.collect()
    assert len(rows) == 30 and sum(r["importance"] for r in rows) == pytest.approx(1)
    assert [r["rank"] for r in rows] == list(range(1, 31))
    top = train.importances(study.model, BASE_FEATURES, 10).collect()
    assert [r["feature"] for r in top] == [r["feature"] for r in rows[:10]]


def test_a_model_ranks_its_own_training_rows_better_than_chance(txn, study):
    inside, _ = sampling.train_test(txn, "txn_id")
    area = evaluate.roc_auc(score(study.model, inside)).first()["roc_auc"]
    assert area > 0.7


@pytest.mark.parametrize("invalid, rows", [("skip", 2), ("keep", 3)])
def test_invalid_rows_are_skipped_or_kept(spark, txn, invalid, rows):
    cols = ["V1", "V14"]
    model = train.gbt_pipeline(cols, weight=None, invalid=invalid, params={"maxIter": 1, "maxDepth": 2}).fit(txn)
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0, 0), (nan, 1.0, 1), (0.5, 0.5, 1)], "V1 double, V14 double, Class int")
    assert score(model, df).count() == rows


def test_invalid_rows_raise_by_default(spark, txn):
    model = train.gbt_pipeline(["V1"], weight=None, params={"maxIter": 1, "maxDepth": 2}).fit(txn)
    df = spark.createDataFrame([(None, 0)], "V1 double, Class int")
    with pytest.raises(Exception):
        score(model, df).collect()


def test_a_filter_above_a_scored_table_is_planned_quickly(txn):
    rows = features.engineered(txn)
    model = train.gbt_pipeline(
        ENGINEERED_FEATURES, weight=None, invalid="skip", params={"maxIter": 1, "maxDepth": 2}
    ).fit(rows)
    assert score(model, rows).filter("Class = 1").count() == txn.filter("Class = 1").count()


def test_unscaled_pipeline(txn):
    model = train.fit_gbt(txn, ["V1", "V4"], weight=None, standardise=False, params={"maxIter": 1, "maxDepth": 2})
    assert len(model.stages) == 2 and score(model, txn).count() == txn.count()


def test_grid_is_the_product_of_its_axes():
    settings = train.grid(TUNING_GRID)
    assert len(settings) == 8 and {"maxIter": 100, "maxDepth": 4, "stepSize": 0.05} in settings


@pytest.fixture(scope="module")
def weighted(txn):
    return sampling.hash_folds(weights.attach(txn), "txn_id").select(*BASE_FEATURES, "Class", "classWeight", "fold", "txn_id")


def test_first_trees_equal_a_separate_fit(weighted):
    params = {"maxDepth": 3, "stepSize": 0.2}
    long, short = (train.fit_gbt(weighted, BASE_FEATURES, params={**params, "maxIter": n}) for n in (6, 3))
    part = train.first_trees(long.stages[-1], 3)
    own = short.stages[-1]
    assert part.getNumTrees == 3 and list(part.treeWeights) == list(own.treeWeights)
    assert [t.toDebugString.split("\n", 1)[1] for t in part.trees] == [t.toDebugString.split("\n", 1)[1] for t in own.trees]
    rows = long.stages[1].transform(long.stages[0].transform(weighted))
    scores = [
        [r["p"] for r in m.transform(rows).orderBy("txn_id").select(positive_probability().alias("p")).collect()] for m in (part, own)
    ]
    assert scores[0] == scores[1]
    for bad in (0, 7):
        with pytest.raises(ValueError):
            train.first_trees(long.stages[-1], bad)


def test_a_search_needs_one_fit_per_number_of_trees_left_out():
    fits = train._fits(train.grid(TUNING_GRID))
    assert len(fits) == 4 and all(params["maxIter"] == 100 for params, _ in fits)
    served = sorted(pair for _, some in fits for pair in some)
    assert [i for i, _ in served] == list(range(8)) and [n for _, n in served] == [50] * 4 + [None] * 4
    assert train._fits([{"maxDepth": 2}, {"maxDepth": 3}]) == [({"maxDepth": 2}, [(0, None)]), ({"maxDepth": 3}, [(1, None)])]


def test_a_search_equals_fits_of_every_setting(weighted):
    cols, axes = ["V1", "V14", "Amount"], {"maxIter": [1, 4], "maxDepth": [2], "stepSize": [0.1, 0.4]}
    found = train.cross_validate(weighted, cols, "fold", axes=axes, parallelism=3, metric="roc_auc").metrics.collect()
    assert len(found) == 4
    for row in found:
        params = {"maxIter": int(row["params"]["maxIter"]), "maxDepth": 2, "stepSize": row["params"]["stepSize"]}
        total = 0.0
        for i in range(3):
            model = train.fit_gbt(weighted.filter(F.col("fold") != i), cols, invalid="skip", params=params)
            total += evaluate.roc_auc(score(model, weighted.filter(F.col("fold") == i))).first()["roc_auc"] / 3
        assert row["avg_metric"] == pytest.approx(total, abs=1e-9)


@pytest.mark.parametrize("collected", [1, 32])
def test_fits_side_by_side_share_their_passes_and_equal_mllib(weighted, monkeypatch, collected):
    cols, passes, total = ["V1", "V4", "V14", "Amount"], [], boost._total
    monkeypatch.setattr(boost, "_total", lambda found, parts: passes.append(parts) or total(found, parts))
    monkeypatch.setattr(boost, "COLLECTED", collected)  # with one, three partitions are summed by a shuffle
    settings = [{"maxIter": 3, "maxDepth": 2, "stepSize": 0.3}, {"maxIter": 2, "maxDepth": 3, "stepSize": 0.1}]
    *stages, trees = train.gbt_pipeline(cols).getStages()
    features_model = Pipeline(stages=stages).fit(weighted)
    models = train._boosted(features_model, weighted.repartition(3), trees, settings)
    assert len(passes) == 3 + 3 + 2 + 1  # the levels of each tree's deepest fit, and the last leaves
    for model, setting in zip(models, settings):
        assert model.getNumTrees == setting["maxIter"] and model.getMaxDepth() == setting["maxDepth"]
        found = train.tree_nodes(PipelineModel([*features_model.stages, model]))
        own = train.tree_nodes(train.gbt_pipeline(cols, params=setting).fit(weighted))
        found, own = ([tuple(r) for r in nodes.na.fill(-1).orderBy("tree", "node").collect()] for nodes in (found, own))
        assert len(found) == len(own)
        for a, b in zip(found, own):
            assert a == pytest.approx(b, rel=1e-6, abs=1e-9)


def test_rows_that_cannot_be_fitted_are_refused(spark):
    rows = [(1.0, 0, 1.0), (2.0, 1, 1.0)]
    for bad in ((3.0, 2, 1.0), (3.0, None, 1.0), (3.0, 1, -1.0), (3.0, 1, None)):
        df = spark.createDataFrame([*rows, bad], "V1 double, Class int, classWeight double")
        with pytest.raises(ValueError, match="1 of 3 rows"):
            train.fit_gbt(df, ["V1"], params={"maxIter": 1}, partitions=1)


def test_splits_of_a_large_training_table_do_not_grow_with_it(spark, weighted, monkeypatch):
    monkeypatch.setattr(train, "ROWS_PER_FILE", 50)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        rows = train._training_input(weighted, ["V1", "Class"])
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        # Four files, each opened at the cost of 4 MB.
        assert sum(sizes) == weighted.count() and max(sizes) <= 4 * 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_split_of_a_large_training_table_holds_at_most_two_spread_parts(spark):
    rows = train._training_input(spark.range(2_400_000), ["id"])
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2_400_000 and max(sizes) <= 2 * train.ROWS_PER_SPLIT


def test_small_training_tables_are_spread_and_large_ones_kept(weighted, monkeypatch):
    rows = weighted.select("V1", "Class").coalesce(2)
    assert train._spread(rows, 3, rows.count()).rdd.getNumPartitions() == 3
    monkeypatch.setattr(train, "ROWS_PER_SPLIT", 1)
    assert train._spread(rows, 3, rows.count()) is rows
    model = train.fit_gbt(weighted, ["V1", "V14"], params={"maxIter": 2, "maxDepth": 2}, partitions=3)
    assert score(model, weighted).count() == weighted.count()


def test_scores_follow_from_the_table_of_nodes(weighted):
    cols = ["V1", "V4", "V14", "Amount"]
    model = train.fit_gbt(weighted, cols, params={"maxIter": 12, "maxDepth": 4, "stepSize": 0.3})
    nodes = train.tree_nodes(model).toPandas()  # noqa: F841 (read by the SQL below)
    assert nodes["tree"].nunique() == 12 and (nodes[nodes.tree == 0].weight == 1.0).all()
    scaled = model.stages[1].transform(model.stages[0].transform(weighted))
    rows = scaled.select("txn_id", vector_to_array("features").alias("x")).toPandas()  # noqa: F841
    found = {r["txn_id"]: r["score"] for r in score(model, weighted, keep=["txn_id"]).collect()}
    walked = duckdb.sql(
        """WITH RECURSIVE walk AS (
             SELECT txn_id, x, tree, node, feature, threshold, "left", "right", value, weight FROM rows, nodes WHERE node = 0
             UNION ALL
             SELECT w.txn_id, w.x, n.tree, n.node, n.feature, n.threshold, n."left", n."right", n.value, n.weight
             FROM walk w JOIN nodes n ON n.tree = w.tree AND w.feature IS NOT NULL
               AND n.node = CASE WHEN w.x[w.feature::INT + 1] <= w.threshold THEN w."left" ELSE w."right" END)
           SELECT txn_id, 1 / (1 + exp(-2 * sum(weight * value))) AS score FROM walk WHERE feature IS NULL GROUP BY txn_id"""
    ).fetchall()
    assert len(walked) == len(found)
    assert all(found[key] == pytest.approx(value, abs=1e-12) for key, value in walked)
    assert set(nodes.feature.dropna().astype(int)) <= set(range(4))


def test_split_first_never_shares_a_key_between_sides(txn):
    inside, validation, test = prepared(txn, ["txn_id"], 10, "split-first")
    for a, b in ((inside, validation), (inside, test), (validation, test)):
        assert a.join(b, "txn_id", "left_semi").count() == 0
    assert inside.select("txn_id").distinct().count() + validation.count() + test.count() == txn.count()


def test_duplicate_first_does(txn):
    inside, _, test = prepared(txn, ["txn_id"], 10, "duplicate-first")
    assert inside.join(test, "txn_id", "left_semi").count() > 0
    with pytest.raises(ValueError):
        prepared(txn, ["txn_id"], 10, "other")


def test_tuned_study_searches_refits_and_picks_a_threshold(txn):
    study = tuned(txn, "txn_id", axes={"maxIter": [1, 2], "maxDepth": [2]}, parallelism=2)
    rows = study.search.metrics.collect()
    assert len(rows) == 2 and sum(r["is_best"] for r in rows) == 1
    best = next(r for r in rows if r["is_best"])
    assert best["avg_metric"] == max(r["avg_metric"] for r in rows)
    trees = study.search.model.stages[-1]
    assert study.search.best == {"maxIter": trees.getNumTrees, "maxDepth": trees.getMaxDepth()}
    assert study.threshold in (0.1, 0.2, 0.3, 0.4, 0.5)
    cells = study.final.first()
    assert cells["tp"] + cells["tn"] + cells["fp"] + cells["fn"] == study.scored.count()


def test_folds_without_both_classes_are_refused(txn):
    df = weights.attach(txn, weights.fit(txn)).withColumn("fold", F.col("Class"))
    with pytest.raises(ValueError, match="both classes"):
        train.cross_validate(df, ["V1"], "fold", 2, axes={"maxIter": [1]})


@pytest.mark.parametrize("odd", [None, 2, -1])
def test_null_and_foreign_folds_are_refused(txn, odd):
    fold = F.when(F.col("txn_id").endswith("7"), F.lit(odd)).otherwise(F.length("txn_id") % 2)
    df = weights.attach(txn, weights.fit(txn)).withColumn("fold", fold.cast("int"))
    with pytest.raises(ValueError, match="null or not in"):
        train.cross_validate(df, ["V1"], "fold", 2, axes={"maxIter": [1]})


def test_drift_holes(spark):
    rows = [(0, 5.0), (0, 50.0), (1, None), (1, None), (None, 5.0), (None, None), (2, 700.0)]
    df = spark.createDataFrame(rows, "hour int, Amount double")
    got = {r["hour"]: r for r in drift.amount_drift(df, "hour", 0).collect()}
    assert {h: (r["rows"], r["missing"]) for h, r in got.items()} == {0: (2, 0), 1: (0, 2), None: (1, 1), 2: (1, 0)}
    assert got[0]["psi"] == pytest.approx(0) and got[1]["psi"] is None and got[None]["psi"] > 0
    for absent in (1, 99):
        assert all(r["psi"] is None for r in drift.amount_drift(df, "hour", absent).collect())


def test_studies_can_drop_their_tables(spark, txn):
    with own_tables(spark) as folder:
        out = baseline(txn, "txn_id", params=TINY).report.collect()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        assert fs.exists(path)
    assert len(out) == 17 and not fs.exists(path)


def test_model_plans_stay_in_the_jvm(txn, study):
    plan = score(study.model, txn)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert operator not in plan


@pytest.mark.parametrize("order", ["split-first", "duplicate-first"])
def test_scaling_counts_rows(txn, order):
    out = scaling(txn, "txn_id", (1, 2), params={"maxIter": 1, "maxDepth": 2}, order=order).collect()
    assert [(r["multiplier"], r["rows"]) for r in out] == [(1, txn.count()), (2, 2 * txn.count())]
    assert all(r["train_seconds"] > 0 and 0 <= r["roc_auc"] <= 1 for r in out)


def test_explore_runs_every_query(txn):
    out = explore(txn, ["txn_id"])
    assert len(out) == 5 and all(timed(df) > 0 for df in out.values())


def test_amount_drift_is_zero_for_the_baseline_and_grows_with_a_shift(txn):
    hours = features.hour_bucket(txn)
    still = {r["hour"]: r["psi"] for r in drift.amount_drift(hours, "hour", 0).collect()}
    moved = drift.amount_drift(drift.shift_amount(hours, "hour", 0.2), "hour", 0)
    shifted = {r["hour"]: r["psi"] for r in moved.collect()}
    assert still[0] == shifted[0] == pytest.approx(0)
    assert all(v >= 0 for v in still.values())
    assert shifted[41] > still[41]


def test_quality_drift_covers_every_bucket(txn, scored):
    df = features.hour_bucket(txn).join(scored.select("txn_id", "score"), "txn_id")
    out = drift.quality_drift(decide(df, 0.5, out="prediction"), "hour").collect()
    assert len(out) == 42
    assert sum(r["tp"] + r["tn"] + r["fp"] + r["fn"] for r in out) == txn.count()


def test_loads_of_parts_equal_one_load(spark, txn, scored, tmp_path):
    df = decide(features.hour_bucket(txn).join(scored.select("txn_id", "score"), "txn_id"), 0.5, out="prediction")
    holes = df.withColumn("hour", F.when(F.col("hour") != 3, F.col("hour"))).withColumn(
        "score", F.when(F.col("V1") < 0.5, F.col("score"))
    )
    state = drift.DriftState(spark, str(tmp_path / "state"), "hour")
    part = F.pmod(F.xxhash64("txn_id"), F.lit(3))
    for day in (0, 1, 2, 1):
        for kind in ("amount", "quality"):
            state.load(holes.filter(part == day), f"day {day}", kind)

    def canonical(out):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in out.collect()), key=repr)

    assert canonical(state.amount_drift(0)) == canonical(drift.amount_drift(holes, "hour", 0))
    assert canonical(state.quality_drift()) == canonical(drift.quality_drift(holes, "hour"))
    # A corrected delivery replaces the first one.
    state.load(holes.filter(part == 0).limit(0), "day 3", "amount")
    state.load(holes.filter((part == 1) & (F.col("hour") < 9)), "day 1", "amount")
    fewer = holes.filter((part != 1) | (F.col("hour") < 9))
    assert canonical(state.amount_drift(0)) == canonical(drift.amount_drift(fewer, "hour", 0))
