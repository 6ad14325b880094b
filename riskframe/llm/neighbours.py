"""Nearest neighbours by largest inner product, with adaptive scans of the dimensions in probed lists.

*Index.*  With one coordinate more, ``sqrt(M**2 - |x|**2)`` for the largest norm ``M``, the largest
inner product is the least distance.  Vectors so extended are turned by a random rotation and go to
the nearest of ``K`` centres, which are fitted on a sample of at most ``SAMPLE`` vectors.  The same
sample tells how many lists a query must probe to find ``recall`` of its neighbours, and gives each
query a first bound: ``k`` neighbours among ``SEEDS`` vectors of it.

*Scan.*  Lists are cut into blocks of at most ``BLOCK`` vectors, a large list into several and small
ones together.  A task holds one block and lets the queries sent to it pass by, so a candidate is sent
once, whatever the number of queries; only a block that more than ``QUERIES`` of them visit is dealt to
several tasks.  Of equal vectors the ``k + 1`` smallest identifiers are candidates, since no other can
be an answer.  The scan adds up distances by blocks of ``STEP`` rotated columns.  After ``d`` of ``D`` columns, the hypothesis that a
candidate lies within the query's bound is rejected, and the candidate abandoned, when its scaled
partial distance exceeds the bound by the factor ``1 + EPSILON / sqrt(d)``.  What is left is scored
exactly on the original vectors in double precision; the ``k`` best so far tighten the bound for the
lists that follow, and the ``k`` best per query and block go on.

Defined results: a vector takes no part when it is null, zero, of another length than the commonest,
or holds a null or non-finite component, nor does a null identifier; exactly repeated rows count
once; rows that share the query's identifier are not its neighbours, and a query identifier with
several vectors gets the best of them all; ties go to the smaller identifier; a query with fewer candidates than ``k`` gets them all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import materialised

SAMPLE = 20_000
SEEDS = 1024
MAX_LISTS = 1024
BLOCK = 8192
QUERIES = 1 << 16
PASSING = 4096
STEP = 16
EPSILON = 2.1
SEED = 7


def usable(vec: Column, size: int | None = None) -> Column:
    """Vectors without null or non-finite components that are not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0)
    return F.coalesce(ok if size is None else ok & (F.size(vec) == size), F.lit(False))


@dataclass
class Index:
    """What every task needs: at most ``SAMPLE`` vectors, ``MAX_LISTS`` centres and a rotation."""

    norm2: float
    rotation: np.ndarray
    centres: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray
    probes: int

    def turned(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        last = np.zeros(len(vectors)) if query else np.sqrt(
            np.maximum(self.norm2 - np.einsum("ij,ij->i", vectors, vectors), 0)
        )
        return np.column_stack([vectors, last]) @ self.rotation

    def nearest(self, turned: np.ndarray) -> np.ndarray:
        """Lists by distance of their centre, nearest first."""
        return np.argsort(_squared(turned, self.centres), axis=1, kind="stable")


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T


def _matrix(column) -> np.ndarray:
    """Vectors of a binary column of doubles."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)


def _centres(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(10):
        of = np.argmin(_squared(points, centres), axis=1)
        size = np.bincount(of, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, points)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def _build(ids: np.ndarray, sample: np.ndarray, n: int, norm2: float, k: int, recall: float) -> Index:
    rng = np.random.default_rng(SEED)
    mixed = rng.permutation(len(ids))
    ids, sample = ids[mixed], sample[mixed]
    rotation, _ = np.linalg.qr(rng.normal(size=(sample.shape[1] + 1,) * 2))
    index = Index(norm2, rotation, np.zeros((1, sample.shape[1] + 1)), ids, sample, 1)
    turned = index.turned(sample)
    lists = int(max(1, min(MAX_LISTS, np.sqrt(n) / 2, len(sample) / 40)))
    index.centres = _centres(turned, lists, rng)
    of = np.argmin(_squared(turned, index.centres), axis=1)
    asked = np.arange(min(len(sample), 512))
    product = sample[asked] @ sample.T
    product[asked, asked] = -np.inf
    best = np.argsort(-product, axis=1)[:, :k]
    order = index.nearest(index.turned(sample[asked], query=True))
    place = np.argsort(order, axis=1)
    # How many lists hold `recall` of all neighbours of the asked, and a few more to be safe.
    need = np.sort(np.take_along_axis(place, of[best], axis=1).ravel()) + 1
    index.probes = min(lists, int(need[min(len(need) - 1, int(recall * len(need)))]) + 1) if len(need) else 1
    return index


def _seeds(
    index: Index, ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every query's ``k`` best among the seeds, scored exactly: (query, sample, score)."""
    product = vectors @ index.sample[:SEEDS].T
    own = ids[:, None] == index.sample_ids[None, :SEEDS]
    product[own] = -np.inf
    best = np.argsort(-product, axis=1, kind="stable")[:, :k]
    i, j = np.repeat(np.arange(len(ids)), best.shape[1]), best.ravel()
    i, j = i[~own[i, j]], j[~own[i, j]]
    return i, j, (vectors[i] * index.sample[j]).sum(axis=1)


def _best(
    i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int
) -> np.ndarray:
    """Places of the ``k`` best identifiers of every ``i``, best first; equal identifiers count once."""
    order = np.lexsort((-score, ids, i))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(i[order]) != 0) | (np.diff(ids[order]) != 0)
    order = order[fresh]
    order = order[np.lexsort((ids[order], -score[order], i[order]))]
    rank = np.arange(len(order)) - np.searchsorted(i[order], i[order], side="left")
    return order[rank < k]


def _scan(
    queries: np.ndarray, bound: np.ndarray, candidates: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) of rotated vectors that no test abandoned; ``bound`` is a squared distance."""
    size = queries.shape[1]
    rows, columns = np.arange(len(queries)), np.arange(len(candidates))
    alive = np.ones((len(rows), len(columns)), bool)
    total = np.zeros(alive.shape, np.float32)
    for start in range(0, size, STEP):
        end = min(start + STEP, size)
        total += _squared(queries[rows, start:end], candidates[columns, start:end])
        factor = 1.0 if end == size else (1 + EPSILON / np.sqrt(end)) ** 2 * end / size
        alive &= total <= (bound[rows] * factor * (1 + 1e-4) + 1e-4)[:, None]
        r, c = alive.any(axis=1), alive.any(axis=0)
        if not r.all() or not c.all():
            rows, columns = rows[r], columns[c]
            alive, total = alive[np.ix_(r, c)], total[np.ix_(r, c)]
        if not alive.size:
            break
    i, j = np.nonzero(alive)
    return rows[i], columns[j]


class _Block:
    """A block of candidates that batches of queries pass by."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, index: Index) -> None:
        self._ids, self._vectors, self._lists, self._index = ids, vectors, lists, index
        self._turned = index.turned(vectors).astype(np.float32)

    def compared(
        self, asked: np.ndarray, asking: np.ndarray, bound: np.ndarray, probes: list[list[int]], k: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best of the block for some queries: identifiers of query and candidate, scores."""
        ids, vectors, index = self._ids, self._vectors, self._index
        turned_q = index.turned(asking, query=True).astype(np.float32)
        length2 = np.einsum("ij,ij->i", asking, asking)
        limit = (length2 + index.norm2 - 2 * bound).astype(np.float32)
        found_i, found_j, found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for one in np.unique(self._lists):
            own = np.flatnonzero(self._lists == one)
            who = np.asarray([i for i, p in enumerate(probes) if one in p], dtype=np.int64)
            for start in range(0, len(who), 512):
                some = who[start : start + 512]
                i, j = _scan(turned_q[some], limit[some], self._turned[own])
                i, j = some[i], own[j]
                other = asked[i] != ids[j]
                i, j = i[other], j[other]
                score = np.empty(len(i))
                for at in range(0, len(i), 100_000):
                    part = slice(at, at + 100_000)
                    score[part] = (asking[i[part]] * vectors[j[part]]).sum(axis=1)
                found_i, found_j = np.append(found_i, i), np.append(found_j, j)
                found = np.append(found, score)
            kept = _best(found_i, ids[found_j], found, k)
            found_i, found_j, found = found_i[kept], found_j[kept], found[kept]
            full, first, size = np.unique(found_i, return_index=True, return_counts=True)
            full, last = full[size == k], (first + size - 1)[size == k]
            limit[full] = np.minimum(limit[full], (length2[full] + index.norm2 - 2 * found[last]).astype(np.float32))
        return asked[found_i], ids[found_j], found


def _passed(
    batches: Iterator[pa.RecordBatch], index: Index, k: int, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    """The best per query and block, from rows sorted by block and part, candidates first."""
    at, block, gathered = None, None, []
    for batch in batches:
        place = np.column_stack([batch["block"].to_numpy(), batch["part"].to_numpy()])
        asks = batch["asks"].to_numpy(zero_copy_only=False)
        new = np.append(True, (place[1:] != place[:-1]).any(axis=1) | (asks[1:] != asks[:-1]))
        starts = np.flatnonzero(new)
        for start, end in zip(starts.tolist(), np.append(starts[1:], len(asks)).tolist()):
            rows = batch.slice(start, end - start)
            if tuple(place[start]) != at:
                at, block, gathered = tuple(place[start]), None, []
            if not asks[start]:
                gathered.append((rows["id"].to_numpy(), _matrix(rows["vec"]), rows["list"].to_numpy()))
                continue
            if block is None and gathered:
                block, gathered = _Block(*(np.concatenate(x) for x in zip(*gathered)), index), []
            for first in range(0, rows.num_rows if block else 0, PASSING):
                some = rows.slice(first, PASSING)
                found = block.compared(
                    some["id"].to_numpy(), _matrix(some["vec"]), some["bound"].to_numpy(), some["lists"].to_pylist(), k
                )
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    recall: float = 0.97,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows of ``vectors`` that ``is_query`` marks."""
    spark = vectors.sparkSession
    whole = vectors.select(
        vectors[id_col].cast("long").alias("id"),
        vectors[vec_col].cast("array<double>").alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter(usable(F.col("vec")) & F.col("id").isNotNull())
    sizes = whole.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    size = sizes["size"]
    rows = whole.filter(F.size("vec") == size).dropDuplicates(["id", "vec"])
    norm2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, largest = rows.agg(F.count(F.lit(1)), F.max(norm2)).first()
    order = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30))
    # Half the bound on average, so that chance never lifts the sample above it.
    share = (1 << 30) if n <= SAMPLE else int((1 << 30) * SAMPLE * 0.9 / n)
    sample = rows.filter(order < share).select("id", "vec").toArrow().sort_by("id")
    points = sample["vec"].combine_chunks().flatten().to_numpy().reshape(-1, size)
    index = spark.sparkContext.broadcast(_build(sample["id"].to_numpy(), points, n, largest, k, recall))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch["vec"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            nearest = index.value.nearest(index.value.turned(flat))[:, 0]
            columns = [batch["id"], batch["asks"], pa.array([v.tobytes() for v in flat]), pa.array(nearest.astype("i4"))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "asks", "vec", "list"])

    listed = materialised(rows.mapInArrow(assign, "id long, asks boolean, vec binary, list int"))
    smallest = Window.partitionBy("vec").orderBy("id")
    answers = listed.withColumn("i", F.row_number().over(smallest)).filter(F.col("i") <= k + 1)
    answers = materialised(answers.select("id", "vec", "list"))
    counts = {r["list"]: r["count"] for r in answers.groupBy("list").count().collect()}
    blocks, pieces = _blocks(counts)
    asking = listed.filter("asks")

    places = spark.createDataFrame(
        [(one, blocks[one], pieces[one]) for one in counts], "at int, first int, pieces int"
    )
    candidates = (
        answers.join(F.broadcast(places), F.col("list") == F.col("at"))
        .withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
        .select("block", "id", "vec", "list")
    )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = index.value
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 512):
                batch = whole_batch.slice(start, 512)
                ids, flat = batch["id"].to_numpy(), _matrix(batch["vec"])
                i, _, score = _seeds(at, ids, flat, k)
                few = np.bincount(i, minlength=len(ids)) < k
                bound = np.full(len(ids), np.inf)
                np.minimum.at(bound, i, score)
                bound[few] = -np.inf
                out = []
                for i, order in enumerate(at.nearest(at.turned(flat, query=True)).tolist()):
                    held, by_block = 0, {}
                    for rank, one in enumerate(order):
                        if rank >= at.probes and held > 2 * k:
                            break
                        if one in counts:
                            held += counts[one]
                            for block in range(blocks[one], blocks[one] + pieces[one]):
                                by_block.setdefault(block, []).append(one)
                    out += [(b, i, lists) for b, lists in by_block.items()]
                chosen = [i for _, i, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _, _ in out], pa.int32()),
                        pa.array(ids[chosen]),
                        batch["vec"].take(pa.array(chosen, pa.int32())),
                        pa.array(bound[chosen]),
                        pa.array([lists for *_, lists in out], pa.list_(pa.int32())),
                    ],
                    names=["block", "id", "vec", "bound", "lists"],
                )

    routed = materialised(
        asking.select("id", "vec").mapInArrow(route, "block int, id long, vec binary, bound double, lists array<int>")
    )
    # One row per block: how many tasks its queries are dealt to.
    dealt = routed.groupBy(F.col("block").alias("at")).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
    here = F.col("block") == F.col("at")
    queries = routed.join(dealt, here).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    sent = candidates.join(dealt, here).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found_type = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = index.value
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 512):
                batch = whole_batch.slice(start, 512)
                ids, flat = batch["id"].to_numpy(), _matrix(batch["vec"])
                i, j, score = _seeds(at, ids, flat, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i]), pa.array(at.sample_ids[j]), pa.array(score)], schema=found_type
                )

    columns = ["block", "part", "asks", "id", "vec", "list", "bound", "lists"]
    both = (
        sent.withColumns({"asks": F.lit(False), "bound": F.lit(None).cast("double"), "lists": F.lit(None).cast("array<int>")})
        .select(*columns)
        .unionByName(queries.withColumns({"asks": F.lit(True), "list": F.lit(None).cast("int")}).select(*columns))
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = both.repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "asks")
    found = met.mapInArrow(
        lambda batches: _passed(batches, index.value, k, found_type), "query_id long, vec_id long, score double"
    )
    # The seeds that gave the bound are neighbours too: with them every query has its k.
    found = found.unionByName(asking.select("id", "vec").mapInArrow(known, found.schema))
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _blocks(counts: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """First block and number of blocks of every list; lists of less than a block share one."""
    blocks, pieces, block, filled = {}, {}, 0, 0
    for one, n in sorted(counts.items()):
        pieces[one] = -(-n // BLOCK)
        if filled and filled + n > BLOCK:
            block, filled = block + 1, 0
        blocks[one] = block
        if pieces[one] > 1:
            block, filled = block + pieces[one], 0
        else:
            filled += n
    return blocks, pieces
