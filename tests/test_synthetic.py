import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import synthetic

FEATURES = ["a", "b", "c"]
SCHEMA = "id string, a double, b double, c double, Class int"


def squared(x, y):
    total = 0.0  # not sum(), which corrects rounding errors
    for p, q in zip(x, y):
        total += (p - q) * (p - q)
    return total


def nearest(rows, k):
    points = {(r[0], r[1:4]) for r in rows if r[0] is not None and r[4] == 1 and all(usable(v) for v in r[1:4])}
    out = {}
    for key, x in points:
        near = sorted({(squared(x, y), other) for other, y in points if other != key})
        out[key] = near[:k]
    return out


def usable(v):
    return v is not None and v == v and abs(v) != float("inf")


def made(rng, n, values):
    return [
        (f"k{i}", *(float(rng.randint(0, values)) if values else rng.random() for _ in range(3)), int(rng.random() < 0.7))
        for i in range(n)
    ]


@pytest.mark.parametrize("values, k, leaf", [(0, 4, 8), (2, 4, 3), (5, 1, 8), (5, 30, 20)])
def test_neighbours_equal_brute_force_with_ties_and_equal_rows(spark, values, k, leaf):
    rows = made(random.Random(values * 31 + k), 90, values)
    df = spark.createDataFrame(rows, SCHEMA).filter("Class = 1")
    found = synthetic.nearest_neighbours(df, "id", FEATURES, k, leaf).found.collect()
    expected = nearest(rows, k)
    assert {r["key"]: [(n["d"], n["key"]) for n in r["neighbours"]] for r in found} == expected
    assert len(found) == len(expected)


@pytest.mark.parametrize("k, reach", [(1, None), (2, None), (2, 1.0), (9, None)])
def test_only_keys_as_near_as_the_last_wanted_point_are_sorted(spark, k, reach):
    points = [([2.0], ["f"]), ([1.0], ["d", "e"]), ([0.0], ["c"]), ([-1.0], ["a", "b"]), ([5.0], ["g"])]
    df = spark.createDataFrame([([0.0], points)], "x array<double>, members array<struct<x: array<double>, keys: array<string>>>")
    out = df.select(synthetic._nearest(F.col("x"), F.col("members"), k, None if reach is None else F.lit(reach)).alias("best"))
    near = sorted((x[0] ** 2, key) for x, keys in points for key in keys if reach is None or x[0] ** 2 <= reach)
    assert [(n["d"], n["key"]) for n in out.first()["best"]] == near[: k + 1]
    assert "array_sort" not in out._jdf.queryExecution().analyzed().toString()


def test_bounds_leave_most_leaves_unvisited(spark):
    rng = random.Random(4)
    centres = [(100.0 * i, 50.0 * (i % 7)) for i in range(40)]
    rows = [(f"{i}-{j}", x + rng.random(), y + rng.random(), 0.0, 1) for i, (x, y) in enumerate(centres) for j in range(25)]
    found = synthetic.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), "id", FEATURES, 3, 10)
    report = found.visits.first()
    assert report["points"] == 1000 and report["leaves"] >= 100
    assert report["visited"] < 0.1 * report["points"] * report["leaves"]
    expected = nearest(rows, 3)
    assert all([n["key"] for n in r["neighbours"]] == [o for _, o in expected[r["key"]]] for r in found.found.collect())


def test_a_third_of_all_rows_of_one_vector(spark):
    rows = [(f"k{i:04d}", 1.0, 2.0, 3.0, 1) for i in range(300)] + made(random.Random(5), 600, 0)
    df = spark.createDataFrame(rows, SCHEMA)
    tree = synthetic.leaves(synthetic._points(df, "id", FEATURES, 5).withColumn("point", F.monotonically_increasing_id()), 16)
    assert tree.points.agg(F.max(F.size("keys"))).first()[0] == 6
    found = synthetic.nearest_neighbours(df.filter("Class = 1"), "id", FEATURES, 5, 16).found.collect()
    expected = nearest(rows, 5)
    assert {r["key"]: [(n["d"], n["key"]) for n in r["neighbours"]] for r in found} == expected


def test_smote_rows_lie_on_the_way_to_a_neighbour(spark):
    rows = made(random.Random(6), 80, 0)
    out = synthetic.smote(spark.createDataFrame(rows, SCHEMA), "id", FEATURES, k=3, factor=4, leaf=8).collect()
    by_key, near = {r[0]: r[1:4] for r in rows}, nearest(rows, 3)
    assert len(out) == 3 * len(near)
    assert {(r["id"], r["copy"]) for r in out} == {(key, c) for key in near for c in (2, 3, 4)}
    for r in out:
        assert r["Class"] == 1 and r["neighbour"] in [o for _, o in near[r["id"]]]
        x, y = by_key[r["id"]], by_key[r["neighbour"]]
        ways = [(r[c] - p) / (q - p) for c, p, q in zip(FEATURES, x, y) if p != q]
        assert all(-1e-9 <= w < 1 for w in ways) and max(ways) - min(ways) < 1e-9
    assert len({r["neighbour"] for r in out}) > 10


def test_smote_does_not_depend_on_partitioning(spark):
    df = spark.createDataFrame(made(random.Random(7), 60, 3), SCHEMA)
    first, second = (
        sorted(map(tuple, synthetic.smote(df.repartition(n), "id", FEATURES, k=2, factor=3, leaf=leaf).collect()))
        for n, leaf in ((1, 4), (5, 50))
    )
    assert first == second and first


def test_defined_results(spark):
    lone = [("p", 1.0, 1.0, 1.0, 1), ("n", 1.0, 1.0, 1.0, 0)]
    nan, inf = float("nan"), float("inf")
    odd = [(None, 1.0, 1.0, 1.0, 1), ("q", None, 1.0, 1.0, 1), ("r", nan, 1.0, 1.0, 1), ("s", inf, 1.0, 1.0, 1)]
    for rows in (lone, lone + odd, lone + lone):
        assert synthetic.smote(spark.createDataFrame(rows, SCHEMA), "id", FEATURES).collect() == []
    empty = spark.createDataFrame([], SCHEMA)
    assert synthetic.smote(empty, "id", FEATURES).collect() == []
    two = spark.createDataFrame(lone + [("t", 1.0, -0.0, 1.0, 1)], SCHEMA)
    whole = synthetic.with_synthetic(two, "id", FEATURES, k=5, factor=3)
    assert whole.count() == 3 + 4 and whole.filter("neighbour is null").count() == 3
    assert synthetic.smote(two, "id", FEATURES, factor=1).collect() == []
    for bad in ({"factor": 0}, {"k": 0}, {"leaf": 0}):
        with pytest.raises(ValueError):
            synthetic.smote(two, "id", FEATURES, **bad)


def test_no_cross_join_and_no_python(spark):
    df = spark.createDataFrame(made(random.Random(8), 40, 0), SCHEMA)
    plan = synthetic.smote(df, "id", FEATURES, k=2)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert operator not in plan


def test_leaves_descend_a_shallow_tree_in_place_of_points(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(f"k{i}", rng.random(), rng.random(), 0.0, 1) for i in range(1000)], SCHEMA)
    points = synthetic._points(df, "id", FEATURES, 5).withColumn("point", F.monotonically_increasing_id())
    tree = synthetic.leaves(points, 10)
    sizes = [r["count"] for r in tree.points.groupBy("node").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 10
    # Cut in halves, a thousand points need seven cuts.
    assert tree.levels <= 6
    boxes = [r for r in tree.boxes.collect() if r["cut"] is None]
    assert len(boxes) == len({r["node"] for r in boxes}) == len(sizes)
    reach = spark.createDataFrame([(r["node"], 0.002) for r in boxes], "home long, reach double")
    found = {(r["home"], r["node"]) for r in synthetic._near_leaves(tree, reach).collect()}

    def apart(a, b):
        gaps = (max(b["low"][i] - a["high"][i], 0.0, a["low"][i] - b["high"][i]) for i in range(3))
        return sum(g * g for g in gaps)

    assert found == {(a["node"], b["node"]) for a in boxes for b in boxes if a is not b and apart(a, b) <= 0.002}
