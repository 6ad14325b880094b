"""Sum-of-squares packing of documents into windows of a fixed number of tokens.

Every task packs the documents of its input split online.  A document's whole windows are closed at
once; its last piece goes to the fill level ``h`` that keeps the sum of squares of ``N`` least, where
``N[h]`` counts the partly filled windows of level ``h``.  Putting a piece of ``s`` tokens on level
``h`` changes that sum by ``2 (N[h + s] - N[h] + 1)``; opening a window and filling one exactly are
the same with the missing term left out.  The array of levels is all that is searched, so a placement
costs one pass over it however many windows are open.

What is still open at the end of a split, or whenever more than ``max_open`` windows are, is closed
by cutting: the emptiest windows are moved, piece by piece, into the gaps of the fullest.  The last
window that remains is cut into powers of two, which need no padding.  No rows are shuffled, and a
lost task packs its split again alike.

Defined results: a null text is an empty one, whose only token is ``end_id``; repeated rows and equal
identifiers are packed as often as they occur; an empty table gives no rows; a text longer than the
window is cut; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskframe.llm.common import slices
from riskframe.llm.tokens import CACHE_WORDS, default_path, encoder

WINDOW = 2048
MAX_OPEN = 4096
ID_BYTES = 4
TASK_BITS = 33


class Piece:
    """``length`` ids of a document from ``start`` on."""

    __slots__ = ("doc", "ids", "start", "tokens")

    def __init__(self, doc, ids: bytes, start: int, tokens: int) -> None:
        self.doc, self.ids, self.start, self.tokens = doc, ids, start, tokens

    @property
    def length(self) -> int:
        return len(self.ids) // ID_BYTES

    def cut(self, at: int) -> tuple[Piece, Piece]:
        head, tail = self.ids[: at * ID_BYTES], self.ids[at * ID_BYTES :]
        return Piece(self.doc, head, self.start, self.tokens), Piece(self.doc, tail, self.start + at, self.tokens)


class Levels:
    """Partly filled windows by fill level."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.bins: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.open = 0

    def place(self, piece: Piece) -> list[Piece] | None:
        """Add the piece; returns the window if that fills it."""
        size, n = piece.length, self.count
        best, least = 0, 2 * n[size] + 1
        if size == self.window:
            least = 0
        levels = np.flatnonzero(n[1 : self.window - size + 1]) + 1
        if levels.size:
            change = 2 * (n[levels + size] - n[levels] + 1)
            change[levels + size == self.window] -= 1
            at = levels.size - 1 - int(np.argmin(change[::-1]))
            if change[at] <= least:
                best = int(levels[at])
        if best:
            bin_ = self.bins[best].pop()
            n[best] -= 1
            self.open -= 1
        else:
            bin_ = []
        bin_.append(piece)
        level = best + size
        if level == self.window:
            return bin_
        self.bins[level].append(bin_)
        n[level] += 1
        self.open += 1
        return None

    def close(self) -> Iterator[list[Piece]]:
        """Empty the levels into full windows and, last, one that may not be full."""
        rest = [b for level in range(self.window, 0, -1) for b in self.bins[level]]
        self.__init__(self.window)
        i, j = 0, len(rest) - 1
        while i < j:
            gap = self.window - sum(p.length for p in rest[i])
            while gap and i < j:
                piece = rest[j].pop()
                if piece.length > gap:
                    kept, piece = piece.cut(piece.length - gap)
                    rest[j].append(kept)
                rest[i].append(piece)
                gap -= piece.length
                if not rest[j]:
                    j -= 1
            if not gap:
                yield rest[i]
                i += 1
        if i == j:
            yield rest[i]


def _powers(bin_: list[Piece], window: int) -> Iterator[list[Piece]]:
    """Cut one window into windows whose lengths are powers of two."""
    total = sum(p.length for p in bin_)
    if total == window:
        yield bin_
        return
    queue = list(reversed(bin_))
    for bit in range(total.bit_length() - 1, -1, -1):
        size, out = total & (1 << bit), []
        while size:
            piece = queue.pop()
            if piece.length > size:
                piece, left = piece.cut(size)
                queue.append(left)
            out.append(piece)
            size -= piece.length
        if out:
            yield out


def pack_split(
    batches: Iterator[pa.RecordBatch],
    schema: pa.Schema,
    task: int,
    window: int,
    end_id: int,
    max_open: int,
    path: str,
    keep_ids: bool,
    cache_words: int = CACHE_WORDS,
) -> Iterator[pa.RecordBatch]:
    levels, rows = Levels(window), []
    last = np.asarray([end_id], "<u4").tobytes()
    serial = task << TASK_BITS

    def done(bin_: list[Piece]) -> None:
        nonlocal serial
        offset = 0
        for p in bin_:
            row = [p.doc, p.start, p.length, zlib.crc32(p.ids), p.tokens, serial, offset]
            rows.append((*row, np.frombuffer(p.ids, "<u4").astype("i4")) if keep_ids else row)
            offset += p.length
        serial += 1

    def flush() -> pa.RecordBatch:
        arrays = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)]
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    for batch in batches:
        for part in slices(batch, "text"):
            texts = [t or "" for t in part["text"].to_pylist()]
            for doc, ids in zip(part["doc"].to_pylist(), encoder(path, cache_words).encode(texts)):
                whole = Piece(doc, ids + last, 0, len(ids) // ID_BYTES + 1)
                while whole.length >= window:
                    head, whole = whole.cut(window)
                    done([head])
                if whole.length and (full := levels.place(whole)):
                    done(full)
                if levels.open > max_open:
                    closed = list(levels.close())
                    for b in closed[:-1]:
                        done(b)
                    left = closed[-1]
                    if (size := sum(p.length for p in left)) == window:
                        done(left)
                    else:
                        levels.bins[size].append(left)
                        levels.count[size] = levels.open = 1
            if rows:
                yield flush()
    for b in levels.close():
        for part in _powers(b, window):
            done(part)
    if rows:
        yield flush()


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = 1,
    max_open: int = MAX_OPEN,
    tokenizer: str | None = None,
    keep_ids: bool = True,
    cache_words: int = CACHE_WORDS,
) -> DataFrame:
    """One row per piece: ``(<id_col>, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``.

    Pieces of one ``sequence_id`` fill it from ``offset`` 0 on without gaps.  All sequences hold
    ``window`` ids, but for at most one run of powers of two per input split.  ``keep_ids`` adds the
    ids themselves.  More ``cache_words`` encode faster; a worker keeps them, some 200 bytes each, for
    the stages that follow.
    """
    path = tokenizer or default_path()
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    fields = [T.StructField("doc", rows.schema["doc"].dataType)]
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields += [T.StructField(n, T.LongType()) for n in names]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    out = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        task = TaskContext.get().partitionId()
        return pack_split(batches, to_arrow_schema(out), task, window, end_id, max_open, path, keep_ids, cache_words)

    return rows.mapInArrow(run, out).withColumnRenamed("doc", id_col)
