import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.session import materialised, shared_path
from riskframe.sources import tables
from riskframe.sources.schema import TXN
from riskframe.sources.tables import read_checked, read_transactions, replace_partitions, write_table


@pytest.fixture(scope="module")
def cards(txn):
    return txn.drop("txn_id")


def same(a, b):
    cols = a.columns
    total = [F.sum(F.xxhash64(*cols) % 1_000_003).alias("h"), F.count(F.lit(1)).alias("n")]
    return a.agg(*total).first() == b.select(*cols).agg(*total).first()


def test_csv_round_trip_with_the_declared_schema(spark, cards):
    path = shared_path(spark, "csv")
    stored = write_table(cards, path, fmt="csv")
    assert stored.schema == T.StructType(list(TXN))
    assert same(cards, stored)
    assert same(cards, read_transactions(spark, path, "csv"))


def test_csv_types_can_be_inferred(spark, cards):
    path = shared_path(spark, "csv")
    write_table(cards.limit(50), path, fmt="csv")
    inferred = read_transactions(spark, path, "csv", schema=None)
    assert inferred.columns == cards.columns and inferred.count() == 50


def test_csv_header_must_match_the_schema(spark, cards):
    path = shared_path(spark, "csv")
    write_table(cards.select(*reversed(cards.columns)), path, fmt="csv")
    with pytest.raises(Exception, match="(?i)header"):
        read_transactions(spark, path, "csv").agg(F.sum("Time"), F.sum("Class")).collect()


def test_csv_files_are_compressed_and_bounded(spark, cards, monkeypatch):
    monkeypatch.setitem(tables.CSV_WRITE, "maxRecordsPerFile", 1_000)
    path = shared_path(spark, "csv")
    stored = write_table(cards, path, fmt="csv")
    per_file = stored.groupBy(F.input_file_name().alias("file")).count().collect()
    assert all(r["file"].endswith(".csv.gz") and r["count"] <= 1_000 for r in per_file)
    assert same(cards, stored)


def test_malformed_rows_are_kept_as_null_or_raise(spark):
    path = shared_path(spark, "csv")
    spark.createDataFrame([("Class,Amount",), ("1,2.5",), ("x,3.5",)], "value string").coalesce(1).write.text(path)
    schema = "Class int, Amount double"
    parsed = T.StructType.fromDDL(schema)
    rows = read_transactions(spark, path, "csv", parsed).collect()
    assert [tuple(r) for r in rows] == [(1, 2.5), (None, 3.5)]
    with pytest.raises(Exception, match="MALFORMED"):
        read_transactions(spark, path, "csv", parsed, malformed="FAILFAST").collect()


def test_partitioned_write_prunes_and_keeps_every_row(spark, cards):
    hours = cards.withColumn("hour", F.floor(F.col("Time") / 3600).cast("int"))
    path = shared_path(spark, "parquet")
    stored = write_table(hours, path, partition_by=["hour"])
    assert same(hours, stored)
    one = stored.filter("hour = 3")
    assert one.count() == hours.filter("hour = 3").count()
    assert "PartitionFilters: [isnotnull(hour" in one._jdf.queryExecution().executedPlan().toString()


def test_an_existing_table_is_not_overwritten_by_default(spark, cards):
    path = shared_path(spark, "parquet")
    write_table(cards.limit(1), path)
    with pytest.raises(Exception, match="(?i)exist"):
        write_table(cards.limit(1), path)
    assert write_table(cards.limit(2), path, mode="overwrite").count() == 2


def test_unknown_formats_are_rejected(spark, cards):
    with pytest.raises(ValueError):
        read_transactions(spark, "/nowhere", "xml")
    with pytest.raises(ValueError):
        write_table(cards, shared_path(spark, "x"), fmt="xml")


def test_materialised_keeps_schema_and_rows(cards):
    stored = materialised(cards)
    assert stored.schema.names == cards.schema.names
    assert same(cards, stored)


SMALL = T.StructType().add("Class", T.IntegerType()).add("Amount", T.DoubleType()).add("Note", T.StringType())


def lines(spark, *text):
    path = shared_path(spark, "csv")
    spark.createDataFrame([(t,) for t in ("Class,Amount,Note", *text)], "value string").coalesce(1).write.text(path)
    return path


def test_lines_that_do_not_fit_come_back_with_their_text(spark):
    bad = ["x,3.5,a", "1,2.5", "1,2.5,a,b", "1,1e,q"]
    path = lines(spark, "1,2.5,a", *bad, ",7.5,", '0,1,"a, b"')
    checked = read_checked(spark, path, SMALL)
    assert checked.accepted.schema == SMALL
    assert sorted(map(tuple, checked.accepted.collect()), key=repr) == [(0, 1.0, "a, b"), (1, 2.5, "a"), (None, 7.5, None)]
    assert sorted(map(tuple, checked.rejected.collect())) == sorted((t, "malformed") for t in bad)
    assert tuple(checked.counts.first()) == (3, 4)


def test_required_columns_reject_rows_without_them(spark):
    path = lines(spark, "1,2.5,a", ",7.5,c", "1,,d", "x,1,e")
    checked = read_checked(spark, path, SMALL, required=["Class", "Amount"])
    assert [tuple(r) for r in checked.accepted.collect()] == [(1, 2.5, "a")]
    found = {(r["line"], r["reason"]) for r in checked.rejected.collect()}
    assert found == {(",7.5,c", "missing"), ("1,,d", "missing"), ("x,1,e", "malformed")}
    assert read_checked(spark, lines(spark), SMALL).counts.first()["accepted"] == 0


def test_checked_reading_still_refuses_a_foreign_header(spark):
    path = shared_path(spark, "csv")
    spark.createDataFrame([("Amount,Class,Note",), ("1,2,3",)], "value string").coalesce(1).write.text(path)
    with pytest.raises(Exception, match="(?i)header"):
        read_checked(spark, path, SMALL)


def test_only_the_partitions_written_are_replaced(spark):
    path = shared_path(spark, "parts")
    schema = "day int, kind string, v int"
    first = spark.createDataFrame([(d, k, d) for d in (1, 2, 3) for k in ("a", "b")], schema)
    replace_partitions(first, path, ["day", "kind"])
    again = spark.createDataFrame([(2, "a", 20), (2, "a", 21), (4, None, 40)], schema)
    for _ in range(2):
        stored = replace_partitions(again, path, ["day", "kind"])
    assert stored.columns == ["v", "day", "kind"]
    assert sorted((tuple(r) for r in stored.select("day", "kind", "v").collect()), key=repr) == [
        (1, "a", 1), (1, "b", 1), (2, "a", 20), (2, "a", 21), (2, "b", 2), (3, "a", 3), (3, "b", 3), (4, None, 40)
    ]
    with pytest.raises(ValueError):
        replace_partitions(first, path, [])


def test_a_lost_job_leaves_the_table_as_it_was(spark):
    path = shared_path(spark, "parts")
    good = spark.createDataFrame([(d, d * 10) for d in range(6)], "day int, v int")
    replace_partitions(good, path, ["day"])
    fails = F.when(F.col("day") == 4, F.raise_error(F.lit("lost")).cast("int")).otherwise(-1)
    with pytest.raises(Exception, match="lost"):
        replace_partitions(good.repartition(3).withColumn("v", fails), path, ["day"])
    stored = read_transactions(spark, path, "parquet", T.StructType.fromDDL("v int, day int"))
    assert sorted((r["day"], r["v"]) for r in stored.collect()) == [(d, d * 10) for d in range(6)]
