"""Gradient-boosted-tree pipelines on MLlib.

Each fit selects only the columns it needs, so the scan is pruned to them.
Boosting is iterative: a checkpoint folder is set beforehand so that MLlib cuts
its lineage every ``checkpointInterval`` trees.  With ``partitions`` the columns
are stored once before the many passes over them: a table of up to
``ROWS_PER_SPLIT`` rows a partition is spread over so many, a larger one is read
in splits that grow in number, not in rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from riskframe.functions.columns import positive_probability
from riskframe.operators import boost, evaluate
from riskframe.session import materialised, shared_dir, shared_path
from riskframe.sources.schema import FOLDS, LABEL, SEED, TUNING_GRID, WEIGHT

#: A table with more rows than so many in each of the partitions asked for keeps its splits.
ROWS_PER_SPLIT = 250_000
#: Rows of a file of a stored training table; with Spark's defaults a split has 32 files at most.
ROWS_PER_FILE = 12_500
#: The setting of which a longer fit contains the shorter ones.
TREES = "maxIter"


def feature_stages(
    cols: Sequence[str], invalid: str = "error", standardise: bool = True
) -> list:
    """Assemble ``cols`` into ``features``.

    ``invalid`` says what a null or NaN does: ``error``, ``skip`` its row, or
    ``keep`` it as NaN.  Skipping is a filter with one condition per column
    instead of the assembler's own: that one is a single condition over all
    columns, from which the optimizer derives exponentially many variants once
    the columns are projections of others.
    """
    stages = []
    if invalid == "skip":
        valid = " AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(double(`{c}`))" for c in cols)
        stages.append(SQLTransformer(statement=f"SELECT * FROM __THIS__ WHERE {valid}"))
    assembled = "raw_features" if standardise else "features"
    stages.append(
        VectorAssembler(
            inputCols=list(cols),
            outputCol=assembled,
            handleInvalid="keep" if invalid == "keep" else "error",
        )
    )
    if standardise:
        stages.append(
            StandardScaler(inputCol=assembled, outputCol="features", withMean=True, withStd=True)
        )
    return stages


def gbt_pipeline(
    cols: Sequence[str],
    label: str = LABEL,
    weight: str | None = WEIGHT,
    invalid: str = "error",
    standardise: bool = True,
    params: Mapping[str, Any] | None = None,
) -> Pipeline:
    trees = GBTClassifier(labelCol=label, featuresCol="features", seed=SEED, **(params or {}))
    if weight is not None:
        trees = trees.setWeightCol(weight)
    return Pipeline(stages=[*feature_stages(cols, invalid, standardise), trees])


def _training_input(df: DataFrame, columns: Sequence[str | None], stored: bool = True) -> DataFrame:
    """The columns a fit needs, stored for its passes."""
    shared_dir(df.sparkSession)
    narrow = df.select(*[c for c in columns if c is not None])
    return materialised(narrow, ROWS_PER_FILE) if stored else narrow


def _fit(rows: DataFrame, stages: Sequence, partitions: int | None) -> PipelineModel:
    """Fit the feature ``stages`` and the trees, the last of ``stages``, on stored ``rows``."""
    features = Pipeline(stages=list(stages[:-1])).fit(rows)
    trees, count = stages[-1], rows.count()
    own = {trees.labelCol, trees.featuresCol, trees.weightCol, trees.seed}
    setting = {p.name: v for p, v in trees.extractParamMap().items() if trees.isSet(p) and p not in own}
    if boost.supports([setting]):
        return PipelineModel([*features.stages, *_boosted(features, _spread(rows, partitions, count), trees, [setting])])
    return PipelineModel([*features.stages, trees.fit(_spread(_vectors(features, rows, trees), partitions, count))])


def _boosted(features: PipelineModel, rows: DataFrame, trees: GBTClassifier, settings: Sequence[Mapping]) -> list[GBTClassificationModel]:
    """One fit for each of ``settings``, side by side; ``features`` is what :func:`feature_stages` became."""
    cols, shift, scale = [], 0.0, 1.0
    for stage in features.stages:
        if isinstance(stage, SQLTransformer):
            rows = stage.transform(rows)
        elif isinstance(stage, VectorAssembler):
            cols = stage.getInputCols()
        else:
            shift, spread = stage.mean.toArray(), stage.std.toArray()
            scale = np.divide(1.0, spread, out=np.zeros(len(cols)), where=spread != 0)
    return boost.boost(rows, cols, shift + np.zeros(len(cols)), scale * np.ones(len(cols)), trees, settings)


def _vectors(features: PipelineModel, rows: DataFrame, trees: GBTClassifier) -> DataFrame:
    weight = [trees.getWeightCol()] if trees.isSet(trees.weightCol) else []
    return features.transform(rows).select("features", trees.getLabelCol(), *weight)


def _spread(vectors: DataFrame, partitions: int | None, rows: int) -> DataFrame:
    """A table of few ``rows`` in ``partitions`` parts; a larger one as it is, in the splits of its files.

    Every stage of every tree carries the lineage of its rows to its tasks, so the small table, of which
    a stage takes little else, is a checkpoint.
    """
    if partitions is None or rows > partitions * ROWS_PER_SPLIT:
        return vectors
    # Round robin: no key, so no partition can be hot.
    return vectors.repartition(partitions).checkpoint()


def fit_gbt(
    train: DataFrame,
    cols: Sequence[str],
    label: str = LABEL,
    weight: str | None = WEIGHT,
    invalid: str = "error",
    standardise: bool = True,
    params: Mapping[str, Any] | None = None,
    partitions: int | None = None,
) -> PipelineModel:
    """Assemble, standardise and boost; ``params`` are GBTClassifier's."""
    rows = _training_input(train, [*cols, label, weight], stored=partitions is not None)
    pipeline = gbt_pipeline(cols, label, weight, invalid, standardise, params)
    return pipeline.fit(rows) if partitions is None else _fit(rows, pipeline.getStages(), partitions)


def grid(axes: Mapping[str, Sequence]) -> list[dict[str, Any]]:
    """Every combination of the listed values."""
    return [dict(zip(axes, values)) for values in product(*axes.values())]


@dataclass
class CrossValidation:
    """``model`` is refitted on all rows with the best settings."""

    model: PipelineModel
    metrics: DataFrame
    best: dict[str, Any]


def _check_folds(rows: DataFrame, fold: str, label: str, k: int) -> None:
    """Raise unless every row lies in a fold 0..k-1 and each fold has both classes; one row comes back."""
    inside = F.col(fold).between(0, k - 1)
    both = [F.count_if((F.col(fold) == i) & (F.col(label) == y)) for i in range(k) for y in (0, 1)]
    outside, *counts = rows.agg(F.count_if(F.col(fold).isNull() | ~inside), *both).first()
    if outside:
        raise ValueError(f"{outside} rows have a fold that is null or not in 0..{k - 1}")
    lacking = [i for i in range(k) if not (counts[2 * i] and counts[2 * i + 1])]
    if lacking:
        raise ValueError(f"every fold 0..{k - 1} needs rows of both classes; not so: {lacking}")


def cross_validate(
    train: DataFrame,
    cols: Sequence[str],
    fold: str,
    k: int = FOLDS,
    label: str = LABEL,
    weight: str | None = WEIGHT,
    invalid: str = "skip",
    axes: Mapping[str, Sequence] = TUNING_GRID,
    metric: str = "pr_auc",
    parallelism: int = 1,
    partitions: int | None = None,
) -> CrossValidation:
    """Compare the settings in ``axes`` over the folds numbered in ``fold``.

    Rows that share a key must share a fold; a null fold or one outside 0..k-1
    is an error.  ``metrics`` has one row per setting: ``(params
    map<string,double>, avg_metric, is_best)``.

    The folds are plain filters on the fold column (MLlib's own ``foldCol``
    sends every row through a Python function).  Assembling and scaling do not
    depend on the settings, so they are fitted once per fold; of a small table their
    result is kept while that fold's settings are tried (see :func:`_spread`).  Settings that differ in the
    number of trees alone share one fit, of the most trees: boosting adds trees
    to those it has, so the first 50 of 100 are what 50 would have been (see
    :func:`first_trees`).  ``parallelism`` fits run at a time, of several folds
    if one has fewer, each on ``partitions`` parts; the refit, which runs alone, takes
    ``parallelism`` parts at least.  One query ranks a fold's rows under all settings;
    ``metric`` is ``pr_auc`` or ``roc_auc``.
    """
    # Read about four times per fold: stored once, as the few columns needed.
    rows = _training_input(train, [*cols, label, weight, fold])
    _check_folds(rows, fold, label, k)
    count = rows.count()
    *stages, trees = gbt_pipeline(cols, label, weight, invalid).getStages()
    settings = grid(axes)
    fits = _fits(settings)
    alike = boost.supports([fit for fit, _ in fits])  # then one pass serves all fits of a fold

    def judged(i: int) -> list[float]:
        inside = rows.filter(F.col(fold) != i)
        features = Pipeline(stages=stages).fit(inside)
        judge_on = _vectors(features, rows.filter(F.col(fold) == i), trees)
        if alike:
            models = dict(enumerate(_boosted(features, _spread(inside, partitions, count), trees, [fit for fit, _ in fits])))
        else:
            fit_on = _spread(_vectors(features, inside, trees), partitions, count)
            maps = [{trees.getParam(name): value for name, value in fit.items()} for fit, _ in fits]
            attempts = trees.fitMultiple(fit_on, maps)
            with ThreadPool(min(parallelism, len(fits))) as pool:
                fitted = inheritable_thread_target(train.sparkSession)(lambda _: next(attempts))
                models = dict(pool.map(fitted, fits))
        scored = [
            (first_trees(models[at], count) if count else models[at])
            .transform(judge_on)
            .select(F.lit(index).alias("setting"), label, positive_probability().alias("score"))
            for at, (_, served) in enumerate(fits)
            for index, count in served
        ]
        scored = materialised(reduce(DataFrame.unionByName, scored))
        areas = {row["setting"]: row[metric] for row in evaluate.ranking(scored, label, by=["setting"]).collect()}
        return [areas[index] for index in range(len(settings))]

    with ThreadPool(max(1, min(k, parallelism if alike else parallelism // len(fits)))) as pool:
        per_fold = pool.map(inheritable_thread_target(train.sparkSession)(judged), range(k))
    totals = [sum(areas) / k for areas in zip(*per_fold)]
    best = settings[max(range(len(settings)), key=totals.__getitem__)]
    # One row per setting, so a local table is the right size for it.
    metrics = train.sparkSession.createDataFrame(
        [({n: float(v) for n, v in s.items()}, m, s is best) for s, m in zip(settings, totals)],
        "params map<string,double>, avg_metric double, is_best boolean",
    )
    refit = gbt_pipeline(cols, label, weight, invalid, params=best).getStages()
    model = _fit(rows, refit, None if partitions is None else max(partitions, parallelism))
    return CrossValidation(model, metrics, best)


def _fits(settings: Sequence[Mapping[str, Any]]) -> list[tuple[dict[str, Any], list[tuple[int, int | None]]]]:
    """The fits that serve all settings: ``(parameters, [(setting, first trees or None for all), ...])``."""
    alike: dict[tuple, list[int]] = {}
    for index, setting in enumerate(settings):
        rest = tuple(sorted((name, value) for name, value in setting.items() if name != TREES))
        alike.setdefault(rest, []).append(index)
    out = []
    for group in alike.values():
        longest = max(group, key=lambda i: settings[i].get(TREES, 0))
        most = settings[longest].get(TREES)
        served = [(i, None if settings[i].get(TREES) == most else settings[i][TREES]) for i in group]
        out.append((dict(settings[longest]), served))
    return out


def first_trees(model: GBTClassificationModel, count: int) -> GBTClassificationModel:
    """The model that boosting had after ``count`` trees: a fit of so many trees gives the same."""
    if not 1 <= count <= model.getNumTrees:
        raise ValueError(f"the model has {model.getNumTrees} trees")
    context, java = SparkContext._active_spark_context, model._java_obj
    jvm, gateway = context._jvm, context._gateway
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, count)
    weights = gateway.new_array(gateway.jvm.double, count)
    for i, (tree, weight) in enumerate(zip(model.trees[:count], model.treeWeights)):
        trees[i], weights[i] = tree._java_obj, weight
    part = jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights)
    java.copyValues(part, java.extractParamMap())
    return GBTClassificationModel(part)


def tree_nodes(model: PipelineModel) -> DataFrame:
    """The boosted trees as a table ``(tree, node, feature, threshold, left, right, value, gain, n, weight)``.

    A row goes ``left`` where the standardised ``feature`` (its place among the features) is at most
    ``threshold``; a leaf has neither.  The score is ``1 / (1 + exp(-2 m))``, where the margin ``m``
    adds up ``weight * value`` of the leaves reached.  MLlib's own storage of a model holds this, so it
    is written to the shared folder and read from there; nothing passes through the driver.
    """
    spark = SparkSession.active()
    path = shared_path(spark, "trees")
    model.stages[-1].save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weights").drop("metadata")
    inner = F.col("leftChild") >= 0
    return nodes.join(weights, "treeID").select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(inner, F.col("leftChild")).alias("left"),
        F.when(inner, F.col("rightChild")).alias("right"),
        F.col("prediction").alias("value"),
        "gain",
        F.col("rawCount").alias("n"),
        F.col("weights").alias("weight"),
    )


def importances(model: PipelineModel, cols: Sequence[str], k: int | None = None) -> DataFrame:
    """``(feature, importance, rank)`` of the fitted trees, largest first."""
    values = model.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(cols, values), key=lambda pair: (-pair[1], pair[0]))
    rows = [(name, float(v), i) for i, (name, v) in enumerate(ranked, start=1)]
    return SparkSession.active().createDataFrame(
        rows[:k], "feature string, importance double, rank int"
    )
