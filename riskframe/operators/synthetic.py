"""Synthetic positives: new rows between a positive and one of its nearest neighbours.

The neighbours are exact.  Positives of equal features form one point, which keeps only as many keys as
can ever be returned.  The points are cut by a k-d tree into leaves of at most ``LEAF`` points: every
level is one aggregate per open node (the range of each feature) and one of its widest feature alone,
at whose approximate quartiles the node is cut into up to ``WAYS`` others.  A leaf's points are kept in
one row.  A point first meets the points of its own leaf; the distance of the last neighbour found there
is its reach.  Then the leaves, not the points, descend the tree level by level, by joins on the node's
number, into boxes within the reach of any of their points; a point meets the points of those leaves
whose box lies within its own reach, and sends on only what lies within it as well.
All pairs meet only where boxes exclude nothing, as with many features of equal spread; ``visits`` tells
the share of leaves that were met.  The tree is a table like any other: nothing of it is collected.

Neighbour and place on the way to it come from hashes of key and copy, so a recomputed task or another
partitioning gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.columns import hash_slot
from riskframe.session import materialised
from riskframe.sources.schema import LABEL, OVERSAMPLING

NEIGHBOURS = 5
LEAF = 128
#: Parts that a node is cut into at most.
WAYS = 4
#: The number of a level's first node is that of the level times so much.
LEVEL = 1 << 56
#: Places on the way from a positive to its neighbour.
PLACES = 1 << 31


@dataclass
class Leaves:
    """``points (point, x, keys, node)`` and ``boxes (node, parent, n, low, high, cut)`` of all nodes."""

    points: DataFrame
    boxes: DataFrame
    levels: int


def squared_distance(x: Column, y: Column) -> Column:
    """The sum of squared differences, added up from the first feature to the last."""
    squares = F.zip_with(x, y, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0.0), lambda total, s: total + s)


def _apart(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Squared distance of two boxes; rounded like that of points of them, so never beyond it."""
    sides = F.arrays_zip(low.alias("a"), high.alias("b"), other_low.alias("c"), other_high.alias("d"))
    gap = F.transform(sides, lambda s: F.greatest(s["c"] - s["b"], F.lit(0.0), s["a"] - s["d"]))
    return F.aggregate(gap, F.lit(0.0), lambda total, g: total + g * g)


def _nodes(active: DataFrame, leaf: int) -> DataFrame:
    """One row per node: its size, its box, and the feature and values to cut it at (null: a leaf)."""
    long = active.select("node", "parent", F.posexplode("x").alias("feature", "v"))
    per = long.groupBy("node", "feature").agg(
        F.first("parent").alias("parent"), F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    widest = F.max_by(F.struct("feature", "low", "high"), F.struct(F.col("high") - F.col("low"), -F.col("feature")))
    rows = per.groupBy("node").agg(
        F.first("parent").alias("parent"),
        F.first("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("feature", "low", "high"))).alias("sides"),
        widest.alias("widest"),
    )
    rows = materialised(rows)
    wide = rows.filter(F.col("n") > leaf).select(F.col("node").alias("own"), F.col("widest.feature").alias("feature"))
    steps = [i / WAYS for i in range(1, WAYS)]
    steps = F.percentile_approx(F.col("x")[F.col("feature")], steps, 1000).alias("steps")
    cuts = active.join(wide, F.col("node") == F.col("own")).groupBy("own").agg(steps)
    # A cut below the largest value leaves points on both sides; half of them or more may share it.
    half = F.col("widest.low") / 2 + F.col("widest.high") / 2
    lone = F.array(F.when(half < F.col("widest.high"), half).otherwise(F.col("widest.low")))
    below = F.array_distinct(F.filter("steps", lambda v: v < F.col("widest.high")))
    at = F.when(F.size(below) > 0, below).otherwise(lone)
    cut = F.when(F.col("n") > leaf, F.struct(F.col("widest.feature").alias("feature"), at.alias("at")))
    return rows.join(cuts, F.col("node") == F.col("own"), "left").select(
        "node", "parent", "n", F.col("sides.low").alias("low"), F.col("sides.high").alias("high"), cut.alias("cut")
    )


def leaves(points: DataFrame, leaf: int = LEAF) -> Leaves:
    """Cut ``points (point, x, keys)`` with distinct ``x`` until no leaf holds more than ``leaf``."""
    none = F.lit(None).cast("bigint")
    active = materialised(points.withColumns({"node": F.lit(0).cast("bigint"), "parent": none}))
    settled, boxes = [], []
    while True:
        # Numbered as they are stored, so that a node's parts are numbers that no other node's have.
        numbered = _nodes(active, leaf).withColumn("place", F.monotonically_increasing_id())
        boxes.append(materialised(numbered))
        cut = boxes[-1].select(F.col("node").alias("own"), "cut", "place")
        placed = active.join(cut, F.col("node") == F.col("own")).drop("own")
        settled.append(placed.filter("cut is null").select("point", "x", "keys", "node"))
        if boxes[-1].filter("cut is not null").isEmpty():
            break
        value = F.col("x")[F.col("cut.feature")]
        part = F.size(F.filter("cut.at", lambda v: value > v))
        further = placed.filter("cut is not null").withColumns(
            {"parent": F.col("node"), "node": F.lit(len(boxes) * LEVEL) + F.col("place") * WAYS + part}
        )
        active = materialised(further.select("point", "x", "keys", "node", "parent"))
    return Leaves(reduce(DataFrame.unionByName, settled), reduce(DataFrame.unionByName, boxes), len(boxes))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _nearest(x: Column, members: Column, k: int, reach: Column | None = None) -> Column:
    """The first ``k + 1`` keys ``(d, key, x)`` of the points in ``members``, by distance and key.

    A point has a key at least, so they lie no farther than the ``k + 1``-th point; only the keys of points
    up to there are spelt out and sorted.
    """
    met = F.transform(members, lambda m: F.struct(squared_distance(x, m["x"]).alias("d"), m["x"].alias("x"), m["keys"].alias("keys")))
    if reach is not None:
        met = F.filter(met, lambda m: m["d"] <= reach)

    def keys_to(met: Column, last: Column) -> Column:
        each = F.transform(
            F.filter(met, lambda m: m["d"] <= last),
            lambda m: F.transform(m["keys"], lambda key: F.struct(m["d"].alias("d"), key.alias("key"), m["x"].alias("x"))),
        )
        return F.slice(F.sort_array(F.flatten(each)), 1, k + 1)

    def first(met: Column) -> Column:
        last = F.coalesce(F.get(F.sort_array(met["d"]), F.lit(k)), F.lit(float("inf")))
        return _with(last, lambda last: keys_to(met, last))

    return _with(met, first)


def _near_leaves(tree: Leaves, reach: DataFrame) -> DataFrame:
    """``(home, node, low, high)``: the other leaves within reach of a leaf's box, by ``reach (home, reach)``."""
    boxes = tree.boxes.select(F.col("node").alias("at"), F.col("parent").alias("up"), "low", "high", F.col("cut").isNull().alias("leaf"))
    homes = boxes.filter("leaf").select(F.col("at").alias("own"), F.col("low").alias("own_low"), F.col("high").alias("own_high"))
    waiting = materialised(
        homes.join(reach, F.col("own") == F.col("home")).drop("own").withColumn("node", F.lit(0).cast("bigint"))
    )
    arrived = [boxes.limit(0).select(F.col("up").alias("home"), F.col("at").alias("node"), "low", "high")]
    for level in range(1, tree.levels):
        own = boxes.filter((F.col("at") >= level * LEVEL) & (F.col("at") < (level + 1) * LEVEL))
        near = waiting.join(own, F.col("node") == F.col("up"))
        within = _apart(*(F.col(c) for c in ("own_low", "own_high", "low", "high"))) <= F.col("reach")
        near = materialised(near.filter(within).drop("node", "up").withColumnRenamed("at", "node"))
        arrived.append(near.filter("leaf and node <> home").select("home", "node", "low", "high"))
        waiting = near.filter("not leaf").drop("leaf", "low", "high")
    return reduce(DataFrame.unionByName, arrived)


@dataclass
class Neighbours:
    """``found (key, x, neighbours)``: the sorted ``(d, key, x)`` of every key's nearest other keys.

    ``visits`` has one row ``(points, leaves, visited)``: visited counts pairs of a point and a leaf.
    """

    found: DataFrame
    visits: DataFrame


def _points(df: DataFrame, key: str, features: Sequence[str], k: int) -> DataFrame:
    """One row per distinct vector with its first ``k + 1`` keys; rows that lack a value are left out."""
    x = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in features])
    usable = F.col("key").isNotNull() & F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    rows = df.select(F.col(key).cast("string").alias("key"), x.alias("x")).filter(usable).distinct()
    first = Window.partitionBy("x").orderBy("key")
    kept = rows.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= k + 1)
    return kept.groupBy("x").agg(F.array_sort(F.collect_list("key")).alias("keys"))


def nearest_neighbours(
    df: DataFrame, key: str, features: Sequence[str], k: int = NEIGHBOURS, leaf: int = LEAF
) -> Neighbours:
    """The ``k`` nearest other keys of every key, by squared distance, equal ones by key.

    Exact.  A key with fewer others has those.  Rows without a key, or with a null or non-finite
    feature, take no part; rows that repeat key and features count once.
    """
    if k < 1 or leaf < 1:
        raise ValueError("k and leaf must be at least 1")
    points = materialised(_points(df, key, features, k).withColumn("point", F.monotonically_increasing_id()))
    tree = leaves(points, leaf)
    # A leaf's points are one row: at most `leaf` of them.  Small parts are not merged, for their leaves take long.
    dealt = tree.points.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    members = materialised(dealt.groupBy("node").agg(F.collect_list(F.struct("point", "x", "keys")).alias("members")))
    inside = members.select("node", "members", F.explode("members").alias("own")).select(
        "node", "own.point", "own.x", "own.keys", _nearest(F.col("own.x"), F.col("members"), k).alias("best")
    )
    # Fewer than k + 1 keys in its own leaf: any leaf may hold a neighbour.
    last = F.coalesce(F.get(F.col("best"), F.lit(k))["d"], F.lit(float("inf")))
    own = materialised(inside.withColumn("reach", last))
    near = materialised(_near_leaves(tree, own.groupBy(F.col("node").alias("home")).agg(F.max("reach").alias("reach"))))
    met = own.select("point", "x", "reach", F.col("node").alias("from")).join(near, F.col("from") == F.col("home"))
    zero = _apart(F.col("x"), F.col("x"), F.col("low"), F.col("high"))
    visits = met.filter(zero <= F.col("reach")).select("point", "x", "reach", "node")
    there = members.withColumnRenamed("node", "at")
    found = visits.join(there, F.col("node") == F.col("at")).select(
        F.col("point").alias("of"), _nearest(F.col("x"), F.col("members"), k, F.col("reach")).alias("some")
    )
    more = materialised(
        found.filter(F.size("some") > 0).groupBy("of").agg(F.flatten(F.collect_list("some")).alias("more"))
    )
    both = F.sort_array(F.concat("best", F.coalesce("more", F.slice("best", 1, 0))))
    listed = own.join(more, F.col("point") == F.col("of"), "left").select(
        "x", "keys", F.slice(both, 1, k + 1).alias("all")
    )

    others = F.slice(F.filter("all", lambda e: e["key"] != F.col("key")), 1, k).alias("neighbours")
    whole = listed.filter(F.size("keys") <= k).select("x", F.explode("keys").alias("key"), "all")
    # Such a point may have more keys than it keeps.
    full = listed.filter(F.size("keys") > k).select("x", "all")
    x = F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in features])
    rows = df.select(F.col(key).cast("string").alias("key"), x.alias("x")).filter("key is not null").distinct()
    owners = whole.select("key", "x", others).unionByName(rows.join(full, "x").select("key", "x", others))
    count = tree.boxes.filter("cut is null").agg(F.count(F.lit(1)).alias("leaves"))
    elsewhere = visits.agg(F.count(F.lit(1)).alias("elsewhere"))
    total = points.agg(F.count(F.lit(1)).alias("points"))
    report = total.select(
        "points",
        count.scalar().alias("leaves"),
        (F.col("points") + elsewhere.scalar()).alias("visited"),
    )
    return Neighbours(owners, report)


def smote(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    k: int = NEIGHBOURS,
    factor: int = OVERSAMPLING,
    label: str = LABEL,
    leaf: int = LEAF,
    salt: str = "smote:",
) -> DataFrame:
    """``factor - 1`` new positives per positive: ``(key, copy, neighbour, features, label)``.

    A copy lies between the positive and one of its ``k`` nearest positives; ``copy`` counts from 2,
    as :func:`sampling.oversample` counts the copies after the first.  A positive without another one
    gets no copies.  Scale the features first if their units differ.
    """
    if factor < 1:
        raise ValueError("factor must be at least 1")
    positives = df.filter(F.col(label) == 1)
    found = nearest_neighbours(positives, key, features, k, leaf).found.filter(F.size("neighbours") > 0)
    numbers = F.sequence(F.lit(2), F.lit(factor)) if factor > 1 else F.array().cast("array<int>")
    copies = found.withColumn("copy", F.explode(numbers))
    name = F.concat_ws("-", "key", F.col("copy").cast("string"))
    pick = F.pmod(hash_slot([name], PLACES, f"{salt}pick:"), F.size("neighbours"))
    chosen = copies.withColumns(
        {"other": F.col("neighbours")[pick], "way": hash_slot([name], PLACES, f"{salt}way:") / F.lit(float(PLACES))}
    )
    between = [
        (F.col("x")[i] + F.col("way") * (F.col("other.x")[i] - F.col("x")[i])).alias(c) for i, c in enumerate(features)
    ]
    return chosen.select(
        F.col("key").alias(key), "copy", F.col("other.key").alias("neighbour"), *between, F.lit(1).alias(label)
    )


def with_synthetic(
    df: DataFrame, key: str, features: Sequence[str], label: str = LABEL, **options
) -> DataFrame:
    """All rows of ``df`` (``copy`` 1, no ``neighbour``) and the synthetic positives below them."""
    own = df.select(
        F.col(key).cast("string").alias(key),
        F.lit(1).alias("copy"),
        F.lit(None).cast("string").alias("neighbour"),
        *[F.col(c).cast("double").alias(c) for c in features],
        F.col(label).cast("int").alias(label),
    )
    return own.unionByName(smote(df, key, features, label=label, **options))
