"""Near-duplicates by an LSH forest over MinHash signatures.

*Sets.*  A document is the set of its distinct word shingles.  Documents of one set form a class, and
only classes go on, each under the smallest identifier in it.

*Forest.*  Every class has ``TREES`` keys of ``DEPTH`` hash minima.  Each tree sorts its keys over the
cluster; the candidates of a key are its neighbours in that order that share a prefix of at least
``SHALLOW`` minima.  In a sparse region that is every key with the prefix; where more than ``REACH``
share it, the neighbours are those with longer common prefixes, so the depth follows the region.

*Links.*  Candidates are confirmed by the size of the intersection of their full sets: first every
class's most promising ones (found in the most trees), then, once linked classes are merged, what
still lies between different components.  Each pair not confirmed lies inside a component that links
have connected already, so the order saves work and loses no link.  Last, every region of more than
``REACH`` neighbours that still holds different components is compared whole, in chunks: pairs with
enough equal minima are confirmed there, and only links leave the task.  A region of more than
``LARGE`` keys first falls apart at greater depth; its members are then compared in the regions of
``MORE`` further trees of depth ``DEPTH`` with hash functions of their own.  At similarity 0.8 those
trees miss a pair with 0.003 %, the regions of ``SHALLOW`` minima with 0.007 %.

Components come from alternating large and small stars, written to the shared folder in every step.

Defined results: texts without words, and null texts, have empty sets and link with nothing; a text
shorter than a shingle is one shingle; repeated rows are one class; rows that share an identifier
share a component; a null identifier has a null component and is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import batches_of, slices
from riskframe.session import materialised

TREES = 24
DEPTH = 8
SHALLOW = 5
REACH = 8
FIRST = 3
PERCENT = 80
LARGE = 20_000
MORE = 56
CHUNK = 4096
CHUNK_BYTES = 32 << 20
PAIRS = 512
SIGMAS = 4.5
SEED = 11

_LEVEL = np.dtype(">u2")
_KEY_BYTES = DEPTH * _LEVEL.itemsize
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX2
    h = (h ^ (h >> np.uint64(27))) * _MIX
    return h ^ (h >> np.uint64(31))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text's number and a 64-bit hash of every word."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    solid = np.flatnonzero(~_BLANK[raw])
    if not solid.size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    firsts = np.flatnonzero(np.diff(solid, prepend=-2) > 1)
    sizes = np.diff(np.append(firsts, len(solid)))
    inside = np.arange(len(solid)) - np.repeat(firsts, sizes)
    powers = np.full(int(sizes.max()), _BASE)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    word = np.add.reduceat((_LOWER[raw[solid]] + np.uint64(1)) * powers[inside], firsts)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    return np.searchsorted(starts, solid[firsts], side="right") - 1, _mixed(word + sizes.astype(np.uint64))


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The text's number and the hash of every distinct shingle, sorted by both."""
    doc, word = _words(texts)
    n = np.bincount(doc, minlength=len(texts))
    parts_doc, parts = [], []
    if len(doc) >= width:
        whole = doc[width - 1 :] == doc[: len(doc) - width + 1]
        h = np.zeros(len(whole), np.uint64)
        for i in range(width):
            h = h * _MIX + word[i : i + len(whole)]
        parts_doc.append(doc[: len(whole)][whole])
        parts.append(_mixed(h[whole]))
    short = np.flatnonzero((n > 0) & (n < width))
    if short.size:
        first = np.concatenate([[0], np.cumsum(n)])
        h = np.zeros(len(short), np.uint64)
        for i in range(width - 1):
            there = n[short] > i
            h[there] = h[there] * _MIX + word[first[short[there]] + i]
        parts_doc.append(short)
        parts.append(_mixed(h ^ n[short].astype(np.uint64)))
    if not parts:
        return doc[:0], word[:0]
    doc, h = np.concatenate(parts_doc), np.concatenate(parts)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[fresh], h[fresh]


def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers and offsets of the hash functions, and the functions of every tree's levels.

    The first ``SHALLOW`` levels of all trees have functions of their own; deeper ones borrow others'.
    """
    rng = np.random.default_rng(SEED)
    count = TREES * SHALLOW
    a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    levels = np.zeros((TREES, DEPTH), np.int64)
    for t in range(TREES):
        own = np.arange(t * SHALLOW, (t + 1) * SHALLOW)
        others = np.setdiff1d(np.arange(count), own)
        levels[t] = np.concatenate([own, rng.choice(others, DEPTH - SHALLOW, replace=False)])
    return a, b, levels


_A, _B, _LEVELS = _functions()


def _more_functions() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the further trees, one for each of their levels."""
    rng = np.random.default_rng(SEED + 1)
    a = rng.integers(0, 1 << 63, MORE * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, MORE * DEPTH, dtype=np.uint64)


_MORE_A, _MORE_B = _more_functions()


def _encoded(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in column.to_pylist()]


def _signed(part: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """Identifier, size and hash of every text's set, and its keys in all trees."""
    texts = _encoded(part["text"])
    doc, h = shingle_sets(texts, width)
    n = np.bincount(doc, minlength=len(texts))
    some = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[some]
    low = np.zeros((len(texts), len(_A)), np.uint32)
    label = np.zeros(len(texts), np.uint64)
    if some.size:
        label[some] = _mixed(np.add.reduceat(_mixed(h), starts) + n[some].astype(np.uint64))
        for i, (a, b) in enumerate(zip(_A, _B)):
            low[some, i] = np.minimum.reduceat(((h * a + b) >> np.uint64(32)).astype(np.uint32), starts)
    # The minima of a level are small numbers; their low bits tell them apart.
    keys = (low & np.uint32(0xFFFF)).astype(_LEVEL)[:, _LEVELS.ravel()]
    return pa.RecordBatch.from_arrays(
        [
            part["id"],
            pa.array(n.astype(np.int64)),
            pa.array(label.view(np.int64)),
            pa.array([k.tobytes() if m else None for k, m in zip(keys, n)], pa.binary()),
        ],
        names=["id", "n", "label", "keys"],
    )


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class and tree."""
    for whole in batches:
        for start in range(0, whole.num_rows, 5_000):
            batch = whole.slice(start, 5_000)
            count = batch.num_rows
            flat = np.frombuffer(b"".join(batch["keys"].to_pylist()), f"S{_KEY_BYTES}")
            offsets = pa.py_buffer(np.arange(0, (len(flat) + 1) * _KEY_BYTES, _KEY_BYTES, dtype=np.int32))
            keys = pa.Array.from_buffers(pa.binary(), len(flat), [None, offsets, pa.py_buffer(flat.tobytes())])
            rows = np.repeat(np.arange(count), TREES)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.arange(TREES, dtype=np.int32), count)),
                    keys,
                    batch["rep"].take(pa.array(rows)),
                    batch["n"].take(pa.array(rows)),
                ],
                names=["tree", "key", "rep", "n"],
            )


def _prefixed(batches: Iterator[pa.RecordBatch], reach: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs ``(a, b)`` and marks ``(a, null, dense)`` of sorted rows with one prefix.

    A region of up to ``reach`` rows gives all its pairs whose sizes allow a link.  In a larger one, which
    is dense and compared whole later, a row is paired with the one before it only.  Every row of a pair
    has a mark, and so has every row of a dense region: one per tree, whatever the region's size.
    """
    held: list[np.ndarray] | None = None
    grown = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = np.frombuffer(b"".join(batch["key"].to_pylist()), _LEVEL).reshape(n, DEPTH)[:, :SHALLOW]
        rows = [batch["tree"].to_numpy(), keys, batch["rep"].to_numpy(), batch["n"].to_numpy()]
        if held is not None:
            rows = [np.concatenate([old, new]) for old, new in zip(held, rows)]
        tree, key, _, _ = rows
        fresh = np.append(True, (tree[1:] != tree[:-1]) | (key[1:] != key[:-1]).any(axis=1))
        starts = np.flatnonzero(fresh)
        # The last region may go on; of a dense one that was passed on already, only its last row is held.
        last = int(starts[-1])
        open_rows = len(tree) - last + (grown if last == 0 else 0)
        if open_rows > reach:
            yield from _near(rows, starts, grown, reach, percent, open_rows)
            held, grown = [r[-1:] for r in rows], open_rows - 1
        else:
            if last:
                yield from _near([r[:last] for r in rows], starts[:-1], grown, reach, percent, 0)
                grown = 0
            held = [r[last:] for r in rows]
    if held is not None and len(held[0]) > 1:
        yield from _near(held, np.zeros(1, np.int64), grown, reach, percent, 0)


def _near(
    rows: list[np.ndarray], starts: np.ndarray, grown: int, reach: int, percent: int, last: int
) -> Iterator[pa.RecordBatch]:
    """Pairs and marks of the regions that begin at ``starts``.

    ``grown`` rows of the first region were passed on before its first row here, which was too;
    ``last`` is the size of the last region if it is known to be dense.
    """
    _, _, rep, size = rows
    sizes = np.diff(np.append(starts, len(rep)))
    true_sizes = sizes.copy()
    true_sizes[0] += grown
    if last:
        true_sizes[-1] = max(true_sizes[-1], last)
    region = np.repeat(np.arange(len(starts)), sizes)
    dense = np.repeat(true_sizes > reach, sizes)
    touched = dense.copy()
    a_parts, b_parts = [], []
    for back in range(1, reach):
        i = np.arange(back, len(rep))
        j = i - back
        near = (region[i] == region[j]) & (rep[i] != rep[j])
        if back > 1:
            near &= ~dense[i]
        near &= 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
        i, j = i[near], j[near]
        if not i.size and back > 1:
            continue
        touched[i] = touched[j] = True
        a_parts.append(np.minimum(rep[i], rep[j]))
        b_parts.append(np.maximum(rep[i], rep[j]))
    if a_parts:
        a, b = np.concatenate(a_parts), np.concatenate(b_parts)
        columns = [pa.array(a), pa.array(b), pa.array(np.zeros(len(a), bool))]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "dense"])
    if grown:
        touched[0] = False  # it had its mark before
    at = np.flatnonzero(touched)
    if at.size:
        columns = [pa.array(rep[at]), pa.nulls(len(at), pa.int64()), pa.array(dense[at])]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "dense"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist()):
            a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            place = np.minimum(np.searchsorted(a, b), len(a) - 1)
            common = int((a[place] == b).sum())
            keep.append(100 * common >= percent * (len(a) + len(b) - common))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the ends of ``edges (a, b)``: the smallest node reachable."""
    stars = materialised(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = state
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v")
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(roots, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialised(small.unionByName(roots.select("u", F.col("m").alias("v"))).distinct())


def _between(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    out = pairs
    for end in ("a", "b"):
        own = parts.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        out = out.join(own, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return out.filter("ca <> cb").select(*pairs.columns)


def _dense(marks: DataFrame, classes: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of dense regions ``(rep, label, keys, component)`` and their keys ``(rep, n, component, tree, key)``."""
    ends = marks.filter("dense").select("node").join(joined, "node", "left")
    ends = ends.withColumn("component", F.coalesce("component", "node"))
    rows = classes.join(ends, F.col("rep") == F.col("node")).select("rep", "n", "label", "keys", "component")
    trees = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(t.alias("tree"), F.substring("keys", t * _KEY_BYTES + 1, F.lit(_KEY_BYTES)).alias("key")),
    )
    planted = rows.select("rep", "n", "component", F.explode(trees).alias("t")).select("rep", "n", "component", "t.*")
    return rows.drop("n"), planted


def _prefix(depth: int) -> Column:
    return F.substring("key", 1, depth * _LEVEL.itemsize)


def _large(planted: DataFrame, depth: int) -> DataFrame:
    """The regions ``(tree, prefix)`` of ``depth`` minima with more than ``LARGE`` rows."""
    counts = planted.groupBy("tree", _prefix(depth).alias("prefix")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.filter(F.col("rows") > LARGE).select("tree", "prefix")


def _regions(placed: DataFrame) -> DataFrame:
    """The regions ``(tree, region, chunks)`` that hold different components: aggregates, no window.

    A chunk holds ``CHUNK`` rows or ``CHUNK_BYTES`` of sets, whichever is less.
    """
    held = placed.groupBy("tree", "region").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("n").alias("shingles"),
        F.min("component").alias("least"),
        F.max("component").alias("most"),
    )
    chunks = F.greatest(F.ceil(F.col("rows") / CHUNK), F.ceil(F.col("shingles") * 8 / CHUNK_BYTES)).cast("int")
    return held.filter("least < most").select(
        F.col("tree").alias("t"), F.col("region").alias("r"), chunks.alias("chunks")
    )


def _region_links(
    marks: DataFrame, classes: DataFrame, sets: DataFrame, joined: DataFrame, percent: int
) -> DataFrame:
    """Links between different components inside dense regions, each region compared whole."""
    rows, planted = _dense(marks, classes, joined)
    planted = materialised(planted)
    placed = planted.withColumn("region", _prefix(SHALLOW))
    for depth in range(SHALLOW, DEPTH):
        # Where a region of this depth is large, its rows go on to the next.
        large = _large(planted, depth).select(F.col("tree").alias("t"), F.col("prefix").alias("r"))
        if large.isEmpty():
            break
        found = (F.col("tree") == F.col("t")) & (F.col("region") == F.col("r"))
        deeper = F.when(F.col("r").isNotNull(), _prefix(depth + 1)).otherwise(F.col("region"))
        placed = placed.join(large, found, "left").withColumn("region", deeper).drop("t", "r")
    shallow = F.length("region") == SHALLOW * _LEVEL.itemsize
    whole = placed.groupBy(F.col("rep").alias("own")).agg(F.min(shallow).alias("whole"))
    held = placed.join(_regions(placed), (F.col("tree") == F.col("t")) & (F.col("region") == F.col("r")))
    held = held.join(whole, F.col("rep") == F.col("own")).select("rep", "tree", "region", "chunks", "whole")
    return _compared(held, rows, sets, percent)


def _fallen(marks: DataFrame, classes: DataFrame, joined: DataFrame) -> DataFrame:
    """The classes ``(node, label)`` with a region that falls apart."""
    rows, planted = _dense(marks, classes, joined)
    keyed = planted.select("rep", "tree", _prefix(SHALLOW).alias("prefix"))
    members = keyed.join(_large(planted, SHALLOW), ["tree", "prefix"], "left_semi").select("rep").distinct()
    return rows.join(members, "rep", "left_semi").select(F.col("rep").alias("node"), "label")


def _more_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class and further tree."""
    for batch in batches:
        sets = [np.frombuffer(x, "<u8") for x in batch["set"].to_pylist()]
        for at, h in enumerate(sets):
            low = np.empty(len(_MORE_A), _LEVEL)
            for i, (a, b) in enumerate(zip(_MORE_A, _MORE_B)):
                low[i] = ((h * a + b) >> np.uint64(32)).min() & np.uint64(0xFFFF)
            keys = [k.tobytes() for k in low.reshape(MORE, DEPTH)]
            node = np.full(MORE, batch["node"][at].as_py(), np.int64)
            trees = np.arange(TREES, TREES + MORE, dtype=np.int32)
            columns = [pa.array(node), pa.array(trees), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "tree", "region"])


def _fallen_links(
    fallen: DataFrame, classes: DataFrame, sets: DataFrame, joined: DataFrame, percent: int
) -> DataFrame:
    """Links between different components inside the regions that ``fallen`` classes have in the further trees."""
    own = joined.withColumnRenamed("node", "rep")
    members = fallen.select(F.col("node").alias("rep"), "label")
    rows = classes.select("rep", "n", "label", "keys").join(members, ["rep", "label"]).join(own, "rep", "left")
    rows = rows.withColumn("component", F.coalesce("component", "rep"))
    keys = sets.join(fallen, ["node", "label"], "left_semi").select("node", "set")
    planted = materialised(keys.mapInArrow(_more_keys, "rep long, tree int, region binary"))
    known = planted.join(rows.select("rep", "n", "component"), "rep")
    held = known.join(_regions(known), (F.col("tree") == F.col("t")) & (F.col("region") == F.col("r")))
    placed = held.select("rep", "tree", "region", "chunks", F.lit(False).alias("whole"))
    return _compared(placed, rows.drop("n"), sets, percent)


def _compared(placed: DataFrame, rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside the regions of ``placed (rep, tree, region, chunks, whole)``.

    A region is cut into chunks, and a task compares two chunks with the full sets at hand, so only
    links leave it.
    """
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    dealt = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keyed = dealt.select(
        "rep", "tree", "region", "whole", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    )
    full = keyed.join(rows, "rep").join(sets.withColumnRenamed("node", "rep"), ["rep", "label"])

    def compare(group: pa.Table) -> pa.Table:
        return _region(group, percent)

    return full.groupBy("tree", "region", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def _region(group: pa.Table, percent: int) -> pa.Table:
    """Links between the components of one region's chunks; two components are joined once."""
    group = group.sort_by("rep")
    rep, own, component = (group[c].to_numpy() for c in ("rep", "own", "component"))
    keys = np.frombuffer(b"".join(group["keys"].to_pylist()), _LEVEL).reshape(len(rep), TREES, DEPTH)
    prefixes = np.ascontiguousarray(keys[:, :, :SHALLOW].astype(np.uint16))
    minima = prefixes.reshape(len(rep), -1)
    sets = [np.frombuffer(s, "<u8") for s in group["set"].to_pylist()]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    count, share = minima.shape[1], percent / 100
    least = count * share - SIGMAS * np.sqrt(count * share * (1 - share))
    across = group["lo"][0].as_py() != group["hi"][0].as_py()
    tree = group["tree"][0].as_py()
    whole = group["whole"].to_pylist()
    part = np.unique(component, return_inverse=True)[1]
    links = []
    for i in range(len(rep)):
        j = np.arange(i + 1, len(rep))
        j = j[part[j] != part[i]]
        if across:
            j = j[own[j] != own[i]]
        j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
        j = j[(minima[j] == minima[i]).sum(axis=1) >= least]
        if whole[i] and tree:
            # An earlier tree with their prefix has the pair in one region, since none of its regions fell apart.
            j = j[~(prefixes[j, :tree] == prefixes[i, :tree]).all(axis=2).any(axis=1)]
        for start in range(0, len(j), CHUNK):
            some = j[start : start + CHUNK]
            every = np.concatenate([sets[x] for x in some])
            place = np.minimum(np.searchsorted(sets[i], every), n[i] - 1)
            common = np.add.reduceat((sets[i][place] == every).astype(np.int64), np.cumsum(n[some]) - n[some])
            linked = some[100 * common >= percent * (n[some] + n[i] - common)]
            for x in linked.tolist():
                if part[x] != part[i]:
                    links.append((min(rep[i], rep[x]), max(rep[i], rep[x])))
                    part[part == part[x]] = part[i]
    a, b = (np.asarray(x, np.int64) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
    return pa.table([a, b], names=["a", "b"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked, stored; two full sets go to Python with each, so few pairs at a time."""
    x = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y")
    with batches_of(pairs.sparkSession, PAIRS):
        return materialised(both.mapInArrow(lambda batches: _linked(batches, percent), "a long, b long"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = PERCENT,
) -> DataFrame:
    """``(<id_col>, n_shingles, component_id, kept)`` of every row; identifiers are whole numbers.

    Two documents are linked when ``100 * intersection >= percent * union`` of their sets of
    ``width``-word shingles; ``component_id`` is the smallest identifier reachable by links.
    """
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _signed(part, width)

    signed = materialised(texts.mapInArrow(sign, "id long, n long, label long, keys binary"))
    classes = materialised(
        signed.filter("n > 0 and id is not null")
        .groupBy("label", "n")
        .agg(F.min("id").alias("rep"), F.min("keys").alias("keys"))
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    planted = classes.select("rep", "n", "keys").mapInArrow(_planted, "tree int, key binary, rep long, n long")
    ordered = planted.repartitionByRange(parts, "tree", "key").sortWithinPartitions("tree", "key", "rep")
    found = ordered.mapInArrow(
        lambda batches: _prefixed(batches, REACH, percent), "a long, b long, dense boolean"
    )
    near = materialised(found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("trees"), F.max("dense").alias("dense")))
    pairs = near.filter("b is not null").select("a", "b", "trees")
    marks = near.filter("b is null").select(F.col("a").alias("node"), "dense")

    wanted = classes.join(marks, F.col("rep") == F.col("node"), "left_semi").select("rep", "label")
    shown = texts.join(wanted, F.col("id") == F.col("rep")).select("rep", "label", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _sets(part, width)

    sets = materialised(
        shown.mapInArrow(gather, "node long, label long, set binary").dropDuplicates(["node", "label"])
    )
    by_a, by_b = (Window.partitionBy(c).orderBy(F.desc("trees"), "a", "b") for c in ("a", "b"))
    ranked = pairs.withColumns({"i": F.row_number().over(by_a), "j": F.row_number().over(by_b)})
    best = ranked.filter((F.col("i") <= FIRST) | (F.col("j") <= FIRST))
    links = _confirmed(best, sets, percent)
    joined = materialised(components(links))
    rest = _confirmed(_between(pairs, joined), sets, percent)
    links = links.unionByName(rest)
    if not rest.isEmpty():
        joined = materialised(components(links))
    rest = materialised(_region_links(marks, classes, sets, joined, percent))
    links = links.unionByName(rest)
    if not rest.isEmpty():
        joined = materialised(components(links))
    fallen = materialised(_fallen(marks, classes, joined))
    if not fallen.isEmpty():
        rest = materialised(_fallen_links(fallen, classes, sets, joined, percent))
        if not rest.isEmpty():
            joined = materialised(components(links.unionByName(rest)))
    own = classes.join(joined, F.col("rep") == F.col("node"), "left").select(
        "label", "n", F.coalesce("component", "rep").alias("component")
    )
    return _verdict(signed, own, id_col)


def _sets(part: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """The sorted sets of the texts that are their class's."""
    texts = _encoded(part["text"])
    doc, h = shingle_sets(texts, width)
    n = np.bincount(doc, minlength=len(texts))
    ends = np.cumsum(n)
    label = part["label"].to_numpy()
    keep, sets = [], []
    for i, (end, size) in enumerate(zip(ends.tolist(), n.tolist())):
        own = h[end - size : end]
        if size and _mixed(np.add.reduce(_mixed(own), keepdims=True) + np.uint64(size)).view(np.int64)[0] == label[i]:
            keep.append(i)
            sets.append(own.astype("<u8").tobytes())
    at = pa.array(keep, pa.int32())
    return pa.RecordBatch.from_arrays(
        [part["rep"].take(at), part["label"].take(at), pa.array(sets, pa.binary())], names=["node", "label", "set"]
    )


def _verdict(signed: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    own = classes.withColumnsRenamed({"label": "l", "n": "m"})
    out = signed.select("id", "n", "label").join(
        own, (F.col("label") == F.col("l")) & (F.col("n") == F.col("m")) & (F.col("n") > 0), "left"
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
