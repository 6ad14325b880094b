import math

import pytest
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.functions import columns as C
from riskframe.operators import features


def test_brackets_are_half_open_and_null_stays_null(bounds):
    out = {r["Amount"]: r["bracket"] for r in features.bucketize(bounds).collect()}
    assert out == {
        0.0: "Micro", 9.99: "Micro", 10.0: "Small", 99.99: "Small", 100.0: "Medium",
        499.99: "Medium", 500.0: "Large", 999.99: "Large", 1000.0: "Very Large", None: None,
    }


def test_bucket_rejects_bad_bounds():
    with pytest.raises(ValueError):
        C.bucket("x", [2, 1])
    with pytest.raises(ValueError):
        C.bucket("x", [1, 2], ["a"])


def test_hour_bucket_floors(spark):
    df = spark.createDataFrame([(0.0,), (3599.9,), (3600.0,), (-1.0,), (None,)], "Time double")
    assert [r["hour"] for r in features.hour_bucket(df).collect()] == [0, 0, 1, -1, None]


def test_log_products_and_squares(spark):
    df = spark.createDataFrame([(0.0, 2.0, 3.0, 4.0), (9.0, None, 1.0, 1.0)], "Amount double, V14 double, V4 double, V12 double")
    a, b = features.engineered(df).collect()
    assert (a["Amount_log"], a["V14_x_V4"], a["V14_x_V12"], a["V4_x_V12"], a["V14_squared"]) == (0.0, 6.0, 8.0, 12.0, 4.0)
    assert b["Amount_log"] == pytest.approx(math.log(10)) and b["V14_squared"] is None


def test_valid_rows_drops_null_and_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, 1.0, 1.0), (2, None, 1.0), (3, nan, 1.0), (4, 1.0, None), (5, 1.0, nan)],
        "id int, V1 double, V2 double",
    )
    assert [r["id"] for r in features.valid_rows(df, ["V1", "V2"]).collect()] == [1]
    assert features.valid_rows(df, ["V1"]).count() == 3


def test_standardize_agrees_with_the_ml_scaler(txn):
    cols = ["Time", "V1", "Amount"]
    ours = features.standardize(txn, cols)
    assembled = VectorAssembler(inputCols=cols, outputCol="raw").transform(ours)
    scaler = StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=True)
    z = vector_to_array("z")
    gap = scaler.fit(assembled).transform(assembled).agg(
        *[F.max(F.abs(z[i] - F.col(f"{c}_std"))).alias(c) for i, c in enumerate(cols)]
    ).first()
    assert max(gap) < 1e-9


def test_standardize_reuses_statistics_and_handles_constants(spark):
    train = spark.createDataFrame([(0.0, 5.0), (2.0, 5.0)], "a double, b double")
    stats = features.fit_scaler(train, ["a", "b"])
    other = spark.createDataFrame([(1.0, 7.0)], "a double, b double")
    row = features.standardize(other, ["a", "b"], stats).first()
    assert (row["a_std"], row["b_std"]) == (0.0, 0.0)
    empty = features.standardize(train.limit(0), ["a"])
    assert empty.collect() == []


def test_hash_slot_gives_null_keys_a_slot_and_rejects_unknown_methods(spark):
    df = spark.createDataFrame([(None,), ("a",)], "k string")
    for method in ("md5", "xxhash64"):
        slots = [r[0] for r in df.select(C.hash_slot(["k"], 7, method=method)).collect()]
        assert all(0 <= s < 7 for s in slots)
    with pytest.raises(ValueError):
        C.hash_slot(["k"], 7, method="other")
