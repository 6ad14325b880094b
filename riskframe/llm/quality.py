"""Document quality by logistic regression over hashed word n-grams.

Words are runs without white space.  The n-grams are of words (1 and 2), of word shapes (1 to 3; a
shape is the word's sequence of letter case, digit and punctuation runs) and of repetition (which of
three successive words are equal).  Each kind has weight 1 per document, shared equally by its
n-grams, and all hash into ``2**BITS`` weights, so a score is one sparse dot product over the whole
text, whatever its length.

Training is follow-the-regularised-leader with per-coordinate rates.  It takes all labelled rows up
to about ``max_rows`` (a stated bound; beyond it, the rows whose hashed identifiers come first).
``SHARDS`` learners each see the rows of one hash range, in hash order, ``epochs`` times; the model is
the mean of their weights.

Defined results: a null or empty text scores the bias alone; a null identifier is scored and never
trained on; labels other than 0 and 1 are left out, and conflicting labels of an identifier count by
their majority (a tie: 1), and of several texts of one identifier one is learned; without labels every score is 0.5; an empty table gives no rows.
``score`` and ``predicted`` replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import slices

BITS = 20
SHARDS = 4
MAX_ROWS = 20_000
KINDS = 6

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 1, 2, 3, 4
_BASE, _MIX, _SALT = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


def _runs_hashed(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Polynomial hash of the run of ``values`` from each of ``firsts`` to the next."""
    sizes = np.diff(np.append(firsts, len(values)))
    inside = np.arange(len(values)) - np.repeat(firsts, sizes)
    powers = np.full(int(sizes.max()), _BASE)
    powers[0] = 1
    return np.add.reduceat((values + np.uint64(1)) * np.cumprod(powers, dtype=np.uint64)[inside], firsts)


def _slot(values: np.ndarray, kind: int) -> np.ndarray:
    h = (values ^ np.uint64((kind + 1) * _SALT % (1 << 64))) * _MIX
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def ngrams(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: the text's number and the slot of every occurrence, text by text."""
    none = np.zeros(0, np.int64)
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    solid = np.flatnonzero(~_BLANK[raw])
    if not solid.size:
        return [(none, none)] * KINDS
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    kept = raw[solid]
    firsts = np.flatnonzero(np.diff(solid, prepend=-2) > 1)
    doc = np.searchsorted(starts, solid[firsts], side="right") - 1
    word = _runs_hashed(_LOWER[kept], firsts)
    shapes = _SHAPE[kept]
    change = np.ones(len(kept), bool)
    change[1:] = shapes[1:] != shapes[:-1]
    change[firsts] = True
    at = np.flatnonzero(change)
    shape = _runs_hashed(shapes[at], np.searchsorted(at, firsts))
    two, three = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    pairs = word[:-1] * _MIX + word[1:]
    shape2 = shape[:-1] * _MIX + shape[1:]
    shape3 = shape2[:-1] * _MIX + shape[2:]
    same = (word[1:] == word[:-1]).astype(np.uint64)
    repeats = same[:-1] * np.uint64(4) + same[1:] * np.uint64(2) + (word[2:] == word[:-2])
    return [
        (doc, _slot(word, 0)),
        (doc[1:][two], _slot(pairs[two], 1)),
        (doc, _slot(shape, 2)),
        (doc[1:][two], _slot(shape2[two], 3)),
        (doc[2:][three], _slot(shape3[three], 4)),
        (doc[2:][three], _slot(repeats[three], 5)),
    ]


def dots(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Weighted sum of every text's n-grams."""
    total = np.zeros(len(texts))
    for doc, slot in ngrams(texts):
        sums = np.bincount(doc, weights[slot], len(texts))
        total += sums / np.maximum(np.bincount(doc, minlength=len(texts)), 1)
    return total


def sparse(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of one text."""
    slots = [slot for _, slot in ngrams([text])]
    values = np.concatenate([np.full(len(s), 1 / max(len(s), 1)) for s in slots])
    used, place = np.unique(np.concatenate(slots), return_inverse=True)
    return used, np.bincount(place, values, len(used))


class Leader:
    """Follow-the-regularised-leader state; the last coordinate is the bias."""

    def __init__(self, rate: float, l1: float, l2: float, smooth: float = 1.0) -> None:
        self.rate, self.l1, self.l2, self.smooth = rate, l1, l2, smooth
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.smooth + np.sqrt(self.n[at])) / self.rate + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        gradient = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
        n = self.n[slots]
        self.z[slots] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.rate * w
        self.n[slots] = n + gradient**2


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in column.to_pylist()]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = MAX_ROWS,
    epochs: int = 6,
    rate: float = 1.0,
    l1: float = 1e-4,
    l2: float = 1e-3,
) -> Model:
    known = labels.filter(labels[label_col].isin(0, 1) & labels[id_col].isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).alias("label"))
    known = known.withColumn("order", F.xxhash64(F.col("id").cast("string")))
    total = known.count()
    steps = 1 << 20
    cut = steps if total <= max_rows else steps * max_rows // total
    # About max_rows rows, whatever the size of the tables: an identifier with several texts gives one.
    sample = F.broadcast(known.filter(F.pmod("order", F.lit(steps)) < cut))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(sample, "id")
    one = F.min_by(F.struct("text", "label", "order"), F.xxhash64("text")).alias("one")
    rows = rows.groupBy("id").agg(one).select("id", "one.*")
    shard = F.pmod(F.xxhash64("order"), F.lit(SHARDS))
    dealt = rows.withColumn("shard", shard).repartition(SHARDS, "shard")
    ordered = dealt.sortWithinPartitions("shard", "order", "id").select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, seen, bias = Leader(rate, l1, l2), [], 1 << BITS
        for batch in batches:
            for part in slices(batch, "text"):
                for text, label in zip(_encoded(part["text"]), part["label"].to_pylist()):
                    slots, values = sparse(text)
                    seen.append((np.append(slots, bias), np.append(values, 1.0).astype("f4"), int(label)))
        for _ in range(epochs):
            for row in seen:
                leader.learn(*row)
        if seen:
            w = leader.weights() * len(seen)
            used = np.append(np.flatnonzero(w[:-1]), bias)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array(w[used]), pa.array((used == bias) * len(seen))],
                names=["slot", "weight", "n"],
            )

    sums = ordered.mapInArrow(run, "slot long, weight double, n long").groupBy("slot")
    # At most 2**BITS + 1 rows.
    table = sums.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).toArrow()
    weights = np.zeros((1 << BITS) + 1)
    n = sum(table["n"].to_pylist())
    if n:
        weights[table["slot"].to_numpy()] = table["weight"].to_numpy() / n
    return Model(weights[:-1].astype(np.float32), float(weights[-1]))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score`` from 0 to 1 and ``predicted``, its rounding."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in keep]).add("score", T.DoubleType())
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        text = text_col if text_col in keep else "__text"
        for batch in batches:
            for part in slices(batch, text):
                found = 1 / (1 + np.exp(-np.clip(dots(_encoded(part[text]), weights) + bias, -35, 35)))
                yield pa.RecordBatch.from_arrays(
                    [*(part[c] for c in keep), pa.array(found)], names=schema.names
                )

    sent_once = [] if text_col in keep else [docs[text_col].alias("__text")]
    rows = docs.select(*[docs[c] for c in keep], *sent_once)
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
