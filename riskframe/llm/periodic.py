"""Maximal periodic runs of words, found by block convolution.

A run is a stretch of words with smallest period ``q`` and length of ``max(least, 2 q)`` or more that
no neighbouring word extends.  Texts are handled many at a time, their words numbered and laid end to
end with separators that match nothing.

*Scales.*  At scale ``B`` (a power of two) the words are cut into aligned blocks of ``B``.  A run of
period ``q`` that is at least ``q + 2 B - 1`` long contains a whole block together with the block's
copy ``q`` words later, so scale ``B`` answers for the periods from ``2 B - 1`` to ``4 B - 2``, and the
scales 2, 4, 8, ... together for all.

*Convolution.*  The sum of squared differences between a block and every place of the window after it
is the two sums of squares less twice their convolution.  That is computed exactly, by number-theoretic
transforms modulo two primes whose product exceeds every such sum; a place where both residues vanish
has no mismatch.  Up to ``DIRECT`` words a block is too short for a transform to pay, and the same
sums are taken term by term.  Blocks whose first or last few words do not recur at any distance of the
scale cannot have a copy and are not convolved, nor are blocks that lie with their window inside a
known run of at most half their length, where a copy can only repeat that run.

*Extension.*  Every distance found seeds the longest stretch of words equal to those ``distance``
later.  Numbers of different words may coincide in the convolution (``LABELS``), never here.  Of equal
stretches the smallest distance is the period.

Defined results: null texts and texts without words have no runs and collapse to an empty string;
there is no longest text and no longest period; repeated rows and null identifiers each give a row; an
empty table gives no rows; further columns of the input are ignored unless named in ``keep``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskframe.llm.common import slices

LEAST = 12
DIRECT = 16
GRAM = 4
#: Squared differences of labels stay below 2^32, so sums over 2^26 words stay below the primes' product.
LABELS = 1 << 16
PRIMES = ((2013265921, 31), (469762049, 3))
CELLS = 1 << 20


def _reduced(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo ``p``; a division by a constant is much faster than a remainder."""
    return x - (x // np.uint64(p)) * np.uint64(p)


def _sum(x: np.ndarray, y: np.ndarray, p: int) -> np.ndarray:
    """``x + y`` modulo ``p`` for reduced terms: what has wrapped around is the larger number."""
    total = x + y
    return np.minimum(total, total - np.uint64(p))


@lru_cache(64)
def _powers(p: int, root: int, size: int, inverse: bool) -> np.ndarray:
    """The first ``size / 2`` powers of a root of unity of order ``size``."""
    base = pow(root, (p - 1) // size, p)
    base = pow(base, p - 2, p) if inverse else base
    powers = np.ones(1, np.uint64)
    while len(powers) < size // 2:
        powers = np.concatenate([powers, _reduced(powers * np.uint64(pow(base, len(powers), p)), p)])
    return powers


def _transformed(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """The number-theoretic transform of every row, in bit-reversed order."""
    rows, size = x.shape
    half = size // 2
    while half:
        pairs = x.reshape(rows, -1, 2, half)
        u, v = pairs[:, :, 0], pairs[:, :, 1]
        low = _sum(u, v, p)
        high = _reduced((u + (np.uint64(p) - v)) * _powers(p, root, 2 * half, False), p)
        x = np.stack([low, high], axis=2).reshape(rows, size)
        half //= 2
    return x


def _restored(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """The inverse of ``_transformed``."""
    rows, size = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(rows, -1, 2, half)
        u, v = pairs[:, :, 0], _reduced(pairs[:, :, 1] * _powers(p, root, 2 * half, True), p)
        x = np.stack([_sum(u, v, p), _sum(u, np.uint64(p) - v, p)], axis=2).reshape(rows, size)
        half *= 2
    return _reduced(x * np.uint64(pow(size, p - 2, p)), p)


def convolved(x: np.ndarray, y: np.ndarray, p: int, root: int) -> np.ndarray:
    """The cyclic convolution modulo ``p`` of the rows of ``x`` and ``y``; a power of two columns."""
    both = _reduced(_transformed(x, p, root) * _transformed(y, p, root), p)
    return _restored(both, p, root)


def matches(blocks: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every stretch of ``windows`` that equals the block of its row.

    Exact: a place is given if and only if the sum of squared differences there is zero.
    """
    size, places = blocks.shape[1], windows.shape[1] - blocks.shape[1] + 1
    if size <= DIRECT:
        total = np.zeros((len(blocks), places), np.int64)
        for i in range(size):
            total += (windows[:, i : i + places] - blocks[:, i : i + 1]) ** 2
        return np.nonzero(total == 0)
    length = 1 << (windows.shape[1] - 1).bit_length()
    squares = np.cumsum(np.pad(windows**2, ((0, 0), (1, 0))), axis=1)
    fixed = (squares[:, size:] - squares[:, :-size] + (blocks**2).sum(axis=1, keepdims=True)).astype(np.uint64)
    x = np.zeros((len(blocks), length), np.uint64)
    y = np.zeros_like(x)
    x[:, :size] = blocks[:, ::-1]
    y[:, : windows.shape[1]] = windows
    zero = np.ones((len(blocks), places), bool)
    for p, root in PRIMES:
        product = convolved(x, y, p, root)[:, size - 1 : size - 1 + places]
        zero &= _reduced(fixed, p) == _sum(product, product, p)
    return np.nonzero(zero)


class _Grams:
    """Which short sequences of words recur, and where."""

    def __init__(self, word: np.ndarray, width: int) -> None:
        mixed = np.zeros(max(len(word) - width + 1, 0), np.uint64)
        for i in range(width):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            mixed += word[i : i + len(mixed)].astype(np.uint64)
        order = np.argsort(mixed, kind="stable")
        fresh = np.diff(mixed[order], prepend=mixed[order[:1]] + np.uint64(1)) != 0
        group = np.cumsum(fresh) - 1
        self._rank = np.empty(len(mixed), np.int64)
        self._rank[order] = group
        repeated = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
        #: One number per occurrence of a sequence that recurs, ascending by sequence and place.
        self._step = len(word) + 1
        self._places = group[repeated] * self._step + order[repeated]

    def recur(self, at: np.ndarray, low: int, high: int) -> np.ndarray:
        """Whether the sequence at ``at`` occurs again ``low`` to ``high`` words later."""
        if not len(self._places):
            return np.zeros(len(at), bool)
        base = self._rank[at] * self._step
        first = np.searchsorted(self._places, base + at + low)
        there = self._places[np.minimum(first, len(self._places) - 1)]
        return (first < len(self._places)) & (there <= base + np.minimum(at + high, self._step - 1))


def _reach(word: np.ndarray, at: int, distance: int, step: int) -> int:
    """How many words on from ``at`` (``step`` 1) or back from it (-1) equal those ``distance`` later."""
    n, done, chunk = len(word), 0, 32
    while True:
        if step > 0:
            low = at + done
            high = min(low + chunk, n - distance)
            differ = np.flatnonzero(word[low:high] != word[low + distance : high + distance])
            if differ.size:
                return done + int(differ[0])
        else:
            high = at + 1 - done
            low = max(high - chunk, 0)
            differ = np.flatnonzero(word[low:high] != word[low + distance : high + distance])
            if differ.size:
                return done + high - low - 1 - int(differ[-1])
        done += max(high - low, 0)
        if high - low < chunk:
            return done
        chunk *= 2


def _seeds(word: np.ndarray, label: np.ndarray, known: list[tuple[int, int, int]], longest: int):
    """Places and distances at which a block's copy follows it, scale by scale.

    ``known`` grows between the scales; ``longest`` is the number of words of the longest text.
    """
    n = len(word)
    grams = {width: _Grams(word, width) for width in (2, GRAM)}
    block = 2
    while block <= GRAM or 4 * block - 2 <= longest:
        # Period 6 alone needs blocks of two words, and blocks of four answer for all below 15.
        low, high = (6, 6) if block == 2 else (1 if block == GRAM else 2 * block - 1, 4 * block - 2)
        at = np.arange(0, n - block - low + 1, block)
        width = min(block, GRAM)
        for place in dict.fromkeys((0, block - width)):
            at = at[grams[width].recur(at + place, low, high)]
        inside = sorted((s, e) for s, e, q in known if 2 * q <= block)
        if inside and at.size:
            starts, ends = (np.asarray(x) for x in zip(*inside))
            ends = np.maximum.accumulate(ends)
            nearest = np.searchsorted(starts, at, side="right") - 1
            at = at[(nearest < 0) | (ends[nearest] < at + high + block)]
        rows = max(1, CELLS // (4 * block))
        span = high - low + block
        for i in range(0, len(at), rows):
            some = at[i : i + rows]
            near = np.arange(span) + (some + low)[:, None]
            windows = np.where(near < n, label[np.minimum(near, n - 1)], LABELS)
            row, place = matches(label[some[:, None] + np.arange(block)], windows)
            yield some[row], place + low
        block *= 2


def find_runs(word: np.ndarray, longest: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of every maximal run, ascending.

    ``word`` numbers the words; a negative number is a separator and occurs once.
    """
    if longest < least:
        return []
    label = np.where(word < 0, LABELS, word % LABELS).astype(np.int64)
    known: list[tuple[int, int, int]] = []
    period: dict[tuple[int, int], int] = {}
    for at, distance in _seeds(word, label, known, longest):
        order = np.lexsort((at, distance))
        done, last = 0, 0
        for j, d in zip(at[order].tolist(), distance[order].tolist()):
            if d == last and j < done:
                continue
            forward = _reach(word, j, d, 1)
            if not forward:
                continue
            last, done = d, j + forward
            start = j - _reach(word, j - 1, d, -1) if j else 0
            end = done + d
            if end - start >= max(least, 2 * d) and d < period.get((start, end), d + 1):
                period[start, end] = d
                known.append((start, end, d))
    return sorted((start, end, d) for (start, end), d in period.items())


def _found(texts: list[bytes], least: int) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """The runs ``(start, length, period)`` of every text, and every text without what they repeat."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    words = [text.split() for text in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    laid = np.empty(int(sizes.sum()) + len(words), np.int64)
    laid[starts + sizes] = -1 - np.arange(len(words))
    laid[_places(sizes)] = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = find_runs(laid, int(sizes.max(initial=0)), least)
    change = np.zeros(len(laid) + 1, np.int32)
    for start, end, period in found:
        own = int(np.searchsorted(starts, start, side="right")) - 1
        runs[own].append((start - int(starts[own]), end - start, period))
        change[start + period] += 1
        change[end] -= 1
    kept = np.cumsum(change) == 0
    collapsed = []
    for own, start, size in zip(words, starts.tolist(), sizes.tolist()):
        stays = kept[start : start + size]
        collapsed.append(b" ".join(own if stays.all() else compress(own, stays.tolist())))
    return runs, collapsed


def _places(sizes: np.ndarray) -> np.ndarray:
    """Where words lie when each text of ``sizes`` words has a separator after it."""
    return np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(<id_col>, *keep, runs, collapsed)`` of every row.

    ``runs`` are structs ``(start, length, period)``, counted in words from 0, by start and period;
    ``collapsed`` is the text's words, a space apart, without those that a run holds after its first
    period.  No shuffle; memory is bounded by a slice of the input or one text.
    """
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words are not looked for")
    kept = [id_col, *keep]
    run_type = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
    schema = T.StructType([docs.schema[name] for name in kept])
    schema = schema.add("runs", T.ArrayType(run_type)).add("collapsed", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = [t or b"" for t in part["__text"].cast(pa.binary()).to_pylist()]
                runs, collapsed = _found(texts, least)
                flat = np.asarray([r for own in runs for r in own], np.int64).reshape(-1, 3)
                ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                kind = out.field("runs").type
                structs = pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=list(kind.value_type)
                )
                lists = pa.ListArray.from_arrays(pa.array(ends), structs, type=kind)
                columns = [part[i] for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, lists, pa.array(collapsed, pa.binary()).cast(pa.string())], schema=out
                )

    return docs.select(*kept, docs[text_col].alias("__text")).mapInArrow(run, schema)
