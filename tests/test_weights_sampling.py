import pytest
from pyspark.sql import functions as F

from riskframe.operators import sampling, weights


def test_weights_sum_to_the_row_count(txn):
    table = weights.balanced(txn).collect()
    assert sum(r["n"] * r["weight"] for r in table) == pytest.approx(txn.count())


def test_weights_of_the_published_class_sizes(spark):
    df = spark.range(284807).select(F.when(F.col("id") < 492, 1).otherwise(0).alias("Class"))
    found = weights.fit(df)
    assert found[1] == pytest.approx(289.438, abs=5e-4)
    assert found[0] == pytest.approx(0.50087, abs=5e-6)
    again = weights.fit(sampling.oversample(df))
    assert again[1] == pytest.approx(29.394, abs=5e-4)
    assert again[0] == pytest.approx(0.50865, abs=5e-6)
    pct = {r["Class"]: r["pct"] for r in weights.class_counts(sampling.oversample(df)).collect()}
    assert pct[1] == pytest.approx(1.701, abs=5e-4)


def test_attach_gives_the_same_weights_lazily_and_as_numbers(txn):
    lazy = weights.attach(txn).groupBy("Class").agg(F.max("classWeight"), F.min("classWeight"))
    fixed = weights.attach(txn, weights.fit(txn)).groupBy("Class").agg(F.max("classWeight"), F.min("classWeight"))
    assert sorted(lazy.collect()) == sorted(fixed.collect())


def test_a_class_without_rows_has_no_weight(spark):
    df = spark.createDataFrame([(0,), (0,)], "Class int")
    assert {r["Class"]: (r["n"], r["weight"]) for r in weights.balanced(df).collect()} == {0: (2, 0.5), 1: (0, None)}
    empty = {r["Class"]: (r["n"], r["pct"]) for r in weights.class_counts(df.limit(0)).collect()}
    assert empty == {0: (0, None), 1: (0, None)}


def test_oversample_copies_positives_only(txn):
    n = txn.groupBy("Class").count().rdd.collectAsMap()
    out = sampling.oversample(txn, factor=10)
    assert out.groupBy("Class").count().rdd.collectAsMap() == {0: n[0], 1: 10 * n[1]}
    per_key = out.filter("Class = 1").groupBy("txn_id").agg(F.collect_set("copy").alias("c")).collect()
    assert all(sorted(r["c"]) == list(range(1, 11)) for r in per_key)


def test_replicate_multiplies_every_row(txn):
    assert sampling.replicate(txn, 5).count() == 5 * txn.count()
    for bad in (sampling.oversample, sampling.replicate):
        with pytest.raises(ValueError):
            bad(txn, **({"factor": 0} if bad is sampling.oversample else {"times": 0}))


def test_split_does_not_depend_on_partitioning(txn):
    def keys(df):
        return {r[0] for r in sampling.train_test(df, "txn_id")[0].select("txn_id").collect()}

    assert keys(txn) == keys(txn.repartition(7)) == keys(txn.coalesce(1))
    assert len(keys(txn)) == 4778


def test_split_keeps_copies_of_a_key_together(txn):
    copies = sampling.oversample(txn)
    train, test = sampling.train_test(copies, "txn_id")
    assert train.count() + test.count() == copies.count()
    assert train.join(test, "txn_id", "left_semi").count() == 0
    folds = sampling.hash_folds(copies, "txn_id", 3).groupBy("txn_id").agg(F.countDistinct("fold").alias("n"))
    assert folds.filter("n > 1").count() == 0


def test_folds_are_balanced_and_independent_of_the_split(txn):
    train, _ = sampling.train_test(txn, "txn_id")
    sizes = [r["count"] for r in sampling.hash_folds(train, "txn_id", 3).groupBy("fold").count().collect()]
    assert len(sizes) == 3 and max(sizes) - min(sizes) < 0.1 * sum(sizes)


def test_composite_keys(txn):
    out = sampling.hash_split(txn, ["txn_id", "Class"]).groupBy("is_train").count().collect()
    assert len(out) == 2


def test_stratified_folds_are_even_and_keep_keys_together(spark):
    rows = [(f"k{i}", 1 if i < 7 else 0) for i in range(200)] + [("k3", 1), ("k50", 0), (None, 0)]
    df = spark.createDataFrame(rows, "key string, Class int").withColumn("fold", F.lit("old"))
    out = sampling.stratified_folds(df, "key", 3)
    assert out.columns == df.columns and out.count() == len(rows)
    folds = out.groupBy("Class", "fold").agg(F.countDistinct(F.coalesce("key", F.lit(""))).alias("n")).collect()
    for label in (0, 1):
        sizes = [r["n"] for r in folds if r["Class"] == label]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1
    assert out.groupBy("key").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert sampling.stratified_folds(df.limit(0), "key").count() == 0


def test_stratified_folds_with_a_third_of_all_rows_under_one_key(spark):
    rows = [(f"k{i % 211}", i % 2) for i in range(1200)] + [("hot", 0)] * 500 + [(None, 1)] * 500 + [("hot:3", 0)] * 2
    df = spark.createDataFrame(rows, "key string, Class int").repartition(6)
    out = sampling.stratified_folds(df, "key", 3)
    keys = {(r["Class"], r["key"] or "", r["fold"]) for r in out.distinct().collect()}
    assert out.count() == len(rows) and len(keys) == len({k[:2] for k in keys})
    # The same folds as ranking the distinct keys by hash in one place.
    import hashlib

    for label in (0, 1):
        names = sorted(
            {k[1] for k in keys if k[0] == label},
            key=lambda n: (int(hashlib.md5(f"fold:{n}".encode()).hexdigest()[:8], 16) % (1 << 31), n),
        )
        assert {k[1]: k[2] for k in keys if k[0] == label} == {n: i % 3 for i, n in enumerate(names)}
    # Rows of hot keys are spread over the join's partitions.
    sizes = [len(part) for part in out.repartition(4, "fold").rdd.glom().collect()]
    assert sum(sizes) == len(rows)


def test_stratified_folds_broadcast_only_the_hot_keys(spark):
    df = spark.createDataFrame([(f"k{i}", i % 2) for i in range(400)] + [("hot", 0)] * 400, "key string, Class int")
    plan = sampling.stratified_folds(df, "key", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 1 and "Window" not in plan


def test_stratified_folds_shuffle_hashes_instead_of_copies_of_the_keys(spark):
    df = spark.createDataFrame([(f"k{i}", i % 2) for i in range(400)], "key string, Class int")
    plan = sampling.stratified_folds(df, "key", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "__key" not in plan and "__hash" in plan


def test_stratified_folds_tell_keys_of_equal_hashes_apart(spark, monkeypatch):
    def few(key, salt):
        text = F.col(key) if isinstance(key, str) else key
        return F.shiftleft(F.conv(F.substring(F.md5(text.cast("binary")), 1, 2), 16, 10).cast("bigint") % 5, 60)

    monkeypatch.setattr(sampling, "_hash", few)
    rows = [(f"k{i}", i % 3 % 2) for i in range(90)] * 2 + [("hot", 0)] * 300 + [(None, 1)] * 300
    df = spark.createDataFrame(rows, "key string, Class int").repartition(3)
    out = sampling.stratified_folds(df, "key", 3)
    keys = {(r["Class"], r["key"], r["fold"]) for r in out.distinct().collect()}
    assert out.count() == len(rows) and len(keys) == len({key[:2] for key in keys}) == 92
    for label in (0, 1):
        sizes = [sum(key[::2] == (label, fold) for key in keys) for fold in range(3)]
        assert max(sizes) - min(sizes) <= 1
