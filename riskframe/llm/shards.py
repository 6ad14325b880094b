"""Shards of near equal bytes as the leaves of a k-d tree over document metadata.

A node that stands for ``k`` shards is cut where the bytes below are ``k // 2`` parts of ``k``, along
the metadata dimension that is widest in it, relative to its width over all documents.  All nodes of a
level are cut together: a weighted median is found by histograms of the bytes per node and interval,
each one aggregate with a partial sum per task, until the cut lies within ``tolerance`` of a shard's
bytes.  The driver holds the tree and one histogram of at most ``BINS`` rows per level; rows find
their node through one broadcast join per level with that level's cuts (at most one row per shard).

Documents of equal text have equal metadata and an equal hash, by which a cut goes on where values
tie, so they stay together; only a text whose copies outweigh the tolerance on either side of a cut is
divided, by a hash of the row.

Defined results: a null text has no bytes, as an empty one; repeated rows and equal or null
identifiers are separate rows; an empty table gives no rows; with fewer rows than shards some shards
stay empty.  Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import numbered
from riskframe.session import materialised

ROW_BYTES = 8
BINS = 1 << 16
HASHES = 1 << 32


@dataclass
class _Node:
    """Shards ``base`` to ``base + k - 1``; ``low`` to ``high`` (included) holds the cut of ``phase``."""

    base: int
    k: int
    dim: int = 0
    phase: int = 0
    low: int = 0
    high: int = 0
    below: int = 0
    target: float = 0.0
    prefix: tuple[int, ...] = ()
    cut: tuple[int, int, int] | None = None

    @property
    def left(self) -> int:
        return self.k // 2


def text_metadata(text: Column) -> dict[str, Column]:
    """Bytes, characters and lines, the same for equal texts."""
    text = F.coalesce(text, F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return {"bytes": F.octet_length(text), "chars": F.length(text), "lines": lines}


def _at(values: tuple[int, ...], i: int) -> int:
    return values[i] if i < len(values) else 0


def _placed(rows: DataFrame, levels: list[list[_Node]]) -> DataFrame:
    """Rows with the ``node`` that the cuts of ``levels`` lead them to."""
    spark = rows.sparkSession
    out = rows.withColumn("node", F.lit(0))
    for nodes in levels:
        cuts = [(n.base, n.base + n.left, n.dim, *n.cut) for n in nodes]
        table = spark.createDataFrame(cuts, "at int, right int, dim int, c0 long, c1 long, c2 long")
        value = F.element_at("dims", F.col("dim") + 1)
        beyond = F.struct(value.alias("a"), F.col("tie").alias("b"), F.col("row").alias("c")) >= F.struct(
            F.col("c0").alias("a"), F.col("c1").alias("b"), F.col("c2").alias("c")
        )
        out = out.join(F.broadcast(table), F.col("node") == F.col("at"), "left").withColumn(
            "node", F.when(F.col("at").isNotNull() & beyond, F.col("right")).otherwise(F.col("node"))
        )
        out = out.select(*rows.columns, "node")
    return out


def _histogram(rows: DataFrame, nodes: list[_Node], bins: int) -> dict[int, dict[int, int]]:
    spark = rows.sparkSession
    state = [
        (n.base, n.dim, n.phase, _at(n.prefix, 0), _at(n.prefix, 1), n.low, n.high, _width(n, bins)) for n in nodes
    ]
    table = spark.createDataFrame(
        state, "at int, dim int, phase int, p0 long, p1 long, low long, high long, width long"
    )
    value = F.element_at("dims", F.col("dim") + 1)
    key = F.when(F.col("phase") == 0, value).when(F.col("phase") == 1, F.col("tie")).otherwise(F.col("row"))
    fits = ((F.col("phase") < 1) | (value == F.col("p0"))) & ((F.col("phase") < 2) | (F.col("tie") == F.col("p1")))
    inside = rows.join(F.broadcast(table), F.col("node") == F.col("at")).withColumn("key", key).filter(
        fits & F.col("key").between(F.col("low"), F.col("high"))
    )
    sums = inside.groupBy("at", F.expr("(key - low) div width").alias("bin")).agg(F.sum("size").alias("w"))
    out: dict[int, dict[int, int]] = {n.base: {} for n in nodes}
    for r in sums.collect():
        out[r["at"]][r["bin"]] = r["w"]
    return out


def _width(n: _Node, bins: int) -> int:
    return -(-(n.high - n.low + 1) // bins)


def _narrow(n: _Node, weights: dict[int, int], bins: int, slack: float) -> None:
    """Set the node's cut, or the smaller interval that holds it."""
    width, below = _width(n, bins), n.below
    last = max(weights, default=0)
    for b in sorted(weights):
        above = below + weights[b]
        if above >= n.target or b == last:
            start = n.low + b * width
            end = start + width
            over, under = above - n.target, n.target - below
            final = n.phase == 2 and width == 1
            if final or min(abs(over), abs(under)) <= slack:
                at = start if abs(under) <= abs(over) else end
                n.cut = tuple((*n.prefix, at, 0, 0)[:3])
            elif width > 1:
                n.low, n.high, n.below = start, min(end - 1, n.high), below
            else:
                n.prefix, n.phase = (*n.prefix, start), n.phase + 1
                n.low, n.high, n.below = 0, HASHES - 1, below
            return
        below = above
    n.cut = tuple((*n.prefix, n.low, 0, 0)[:3])


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: Mapping[str, Column] | None = None,
    tolerance: float = 0.005,
) -> DataFrame:
    """``(<id_col>, size, text_crc32, shard, slot)``: a gapless ``slot`` from 0 in every shard.

    The number of shards is given or follows from ``target_bytes`` per shard.  ``metadata`` maps names
    to whole-number columns of ``docs``; with the default, equal texts have equal values.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give shards or target_bytes")
    text = docs[text_col]
    dims = [F.coalesce(c.cast("long"), F.lit(0)) for c in (metadata or text_metadata(text)).values()]
    rows = materialised(
        docs.select(
            docs[id_col].alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.array(*dims).alias("dims"),
            F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(HASHES)).alias("tie"),
            F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(HASHES)).alias("row"),
        )
    )
    count, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    levels: list[list[_Node]] = []
    nodes = [_Node(0, shards)] if count else []
    spread: list[int] = []
    while nodes := [n for n in nodes if n.k > 1]:
        placed = _placed(rows, levels)
        ranges = [f(F.col("dims")[i]) for i in range(len(dims)) for f in (F.min, F.max)]
        held = {r[0]: r[1:] for r in placed.groupBy("node").agg(F.sum("size"), *ranges).collect()}
        for n in nodes:
            weight, *ends = held.get(n.base, (0, *[0] * (2 * len(dims))))
            widths = [high - low for low, high in zip(ends[::2], ends[1::2])]
            spread = spread or [w + 1 for w in widths]
            n.dim = max(range(len(dims)), key=lambda i: widths[i] / spread[i])
            n.low, n.high = ends[2 * n.dim], ends[2 * n.dim + 1]
            n.target = weight * n.left / n.k
        slack = tolerance * total / shards
        while todo := [n for n in nodes if n.cut is None]:
            bins = max(16, BINS // len(todo))
            for base, weights in _histogram(placed, todo, bins).items():
                _narrow(next(n for n in todo if n.base == base), weights, bins, slack)
        levels.append(nodes)
        nodes = [c for n in nodes for c in (_Node(n.base, n.left), _Node(n.base + n.left, n.k - n.left))]
    placed = _placed(rows, levels).withColumnRenamed("node", "shard")
    out = numbered(placed, "shard", F.col("row"), "slot", count)
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
