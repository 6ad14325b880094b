"""The transaction table: column names, types and feature lists."""

from __future__ import annotations

from pyspark.sql import types as T

TIME = "Time"
AMOUNT = "Amount"
LABEL = "Class"
WEIGHT = "classWeight"
COMPONENTS = [f"V{i}" for i in range(1, 29)]

TXN = T.StructType(
    [T.StructField(TIME, T.DoubleType())]
    + [T.StructField(name, T.DoubleType()) for name in COMPONENTS]
    + [T.StructField(AMOUNT, T.DoubleType()), T.StructField(LABEL, T.IntegerType())]
)

# Amount bracket bounds (lower bound inclusive) and their names.
AMOUNT_BOUNDS = [10.0, 100.0, 500.0, 1000.0]
AMOUNT_BRACKETS = ["Micro", "Small", "Medium", "Large", "Very Large"]

# Feature pairs multiplied and features squared by the tuned recipe.
INTERACTIONS = [("V14", "V4"), ("V14", "V12"), ("V4", "V12")]
SQUARES = ["V14"]

BASE_FEATURES = [TIME, *COMPONENTS, AMOUNT]
ENGINEERED_FEATURES = [
    TIME,
    *COMPONENTS,
    "Amount_log",
    *[f"{a}_x_{b}" for a, b in INTERACTIONS],
    *[f"{name}_squared" for name in SQUARES],
]

# The settings the published figures were made with.
BASELINE_PARAMS = {"maxIter": 50, "maxDepth": 5, "stepSize": 0.1}
SCALING_PARAMS = {"maxIter": 20, "maxDepth": 4}
TUNING_GRID = {"maxIter": [50, 100], "maxDepth": [4, 6], "stepSize": [0.05, 0.1]}
THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5)
MULTIPLIERS = (1, 2, 5, 10)
OVERSAMPLING = 10
FOLDS = 3
TRAIN_PCT = 80
SEED = 42
