"""URL rules, and a character language-model ratio for the URLs that no rule decides.

Two variable-order Markov models, of accepted and of rejected URLs, give every byte a probability
from the up to ``ORDER`` bytes before it: the estimate of each order is smoothed by the next lower
one, down to equal chances.  A URL's score is the log of the ratio of both models' probabilities,
divided by its number of bytes plus one (for the end); the cut between the verdicts is the one with
the least balanced error on labelled URLs that the counts have not seen.

Counts are gathered from all labelled URLs, summed per batch before the shuffle, and stay a stored
table, whole however large.  For scoring, the distinct URLs are sorted and cut into chunks of
``CHUNK_BYTES``; a chunk asks for each of its contexts and symbols once, a join by key answers, and the
chunk's URLs meet their counts in one task.  A key is asked for once per chunk, so none is hot.

Defined results: a null URL is an empty one, with empty host and path and no rule; repeated URLs
count as often as they occur; when either model has no URLs, all that no rule decides is allowed; an
empty table gives no rows.  Added columns replace those of their name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import ascii_lower
from riskframe.session import materialised

ORDER = 5
STRENGTH = 2.0
SYMBOLS = 257
FOLDS = 5
STEPS_PER_UNIT = 1000
URLS = 2_000
CHUNK_BYTES = 1 << 16

#: The rules that the registered query applies, as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SALT = 0xD6E8FEB86659FD93


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, _URL, 1)), F.regexp_extract(text, _URL, 2)


def with_rule(pages: DataFrame, url_col: str, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``ruled``, the verdict of the longest rule that fits, or null."""
    host, path = parsed(pages[url_col])
    out = pages.withColumns({"host": host, "path": path})
    rule = verdict = F.lit(None).cast("string")
    for kind, of, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == of) | F.col("host").endswith(f".{of}")) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, f"{of}{start}").otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return out.withColumns({"rule": rule, "ruled": verdict})


# --- models ----------------------------------------------------------------


def _places(urls: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For all bytes and ends of ``urls``: the URL's number, its first place, and keys by order.

    The keys of an order are hashes of the context alone and of the context with the symbol.  A
    context that would reach before the URL's start holds the start mark 0 there.
    """
    sizes = np.fromiter((len(u) + 1 for u in urls), np.int64, len(urls))
    starts = np.cumsum(sizes) - sizes
    symbols = np.zeros(int(sizes.sum()), np.uint64)
    inner = np.ones(len(symbols), bool)
    inner[starts + sizes - 1] = False
    symbols[inner] = np.frombuffer(b"".join(urls), np.uint8).astype(np.uint64) + np.uint64(1)
    symbols[~inner] = SYMBOLS
    inside = np.arange(len(symbols)) - np.repeat(starts, sizes)
    context = np.zeros(len(symbols), np.uint64)
    keys = []
    for k in range(order + 1):
        if k:
            back = np.zeros(len(symbols), np.uint64)
            reach = inside >= k
            back[reach] = symbols[np.flatnonzero(reach) - k]
            context = context * _STEP + back + np.uint64(1)
        keys.append((_key(context, k, 0), _key(context * _MIX + symbols, k, 1)))
    return np.repeat(np.arange(len(urls)), sizes), starts, keys


def _key(values: np.ndarray, order: int, kind: int) -> np.ndarray:
    h = (values ^ np.uint64((order * 2 + kind + 1) * _SALT % (1 << 64))) * _STEP
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return (h ^ (h >> np.uint64(32))).view(np.int64)


@dataclass
class Ratio:
    """Counts of both models, a stored table ``(key, no, yes)`` (none without both), and the least score that is accepted."""

    table: DataFrame | None
    cut: float


def scores(urls: list[bytes], known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log ratio per byte and end of the accepted and the rejected model.

    ``known`` are sorted keys, among them all of ``urls`` that were counted; ``counts`` those of the
    rejected and the accepted model.
    """
    if not urls:
        return np.zeros(0)
    _, starts, keys = _places(urls, ORDER)
    chances = np.full((2, len(keys[0][0])), 1 / SYMBOLS)
    if len(known):
        for context, gram in keys:
            seen, total = _counts(known, counts, gram), _counts(known, counts, context)
            chances = (seen + STRENGTH * chances) / (total + STRENGTH)
    logs = np.log(chances)
    sizes = np.diff(np.append(starts, logs.shape[1]))
    return np.add.reduceat(logs[1] - logs[0], starts) / sizes


def _counts(known: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[:, at], 0.0)


def _bytes(column: pa.Array) -> list[bytes]:
    return [(u or "").encode("utf-8", "replace") for u in column.to_pylist()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        accepted = batch["accepted"].to_numpy(zero_copy_only=False).astype(bool)
        for start in range(0, batch.num_rows, URLS):
            of, _, keys = _places(_bytes(batch["url"].slice(start, URLS)), ORDER)
            side = accepted[start : start + URLS][of]
            every = np.concatenate([k for pair in keys for k in pair])
            used, place = np.unique(every, return_inverse=True)
            total = np.bincount(place, minlength=len(used))
            yes = np.bincount(place, np.tile(side, 2 * len(keys)), len(used)).astype(np.int64)
            columns = [pa.array(used), pa.array(total - yes), pa.array(yes)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "no", "yes"])


def fit(urls: DataFrame, url_col: str, accepted_col: str) -> Ratio:
    """Models of the URLs with a boolean label; rows with a null label are left out.

    One of ``FOLDS`` parts of the distinct URLs calibrates the cut, the others are counted.
    """
    labelled = urls.filter(urls[accepted_col].isNotNull()).select(
        F.coalesce(urls[url_col], F.lit("")).alias("url"), urls[accepted_col].alias("accepted")
    )
    part = F.pmod(F.xxhash64("url"), F.lit(FOLDS))
    partial = labelled.filter(part != 0).mapInArrow(_counted, "key long, no long, yes long")
    table = materialised(partial.groupBy("key").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")))
    if not all(table.agg(F.max("no"), F.max("yes")).first()):
        return Ratio(None, -np.inf)
    model = Ratio(table, -np.inf)
    held = score(labelled.filter(part == 0), model, "url")
    bins = held.groupBy(F.floor(F.col("score") * STEPS_PER_UNIT).alias("bin")).agg(
        F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no")
    )
    # One row per thousandth between the least and the largest score, which the smoothing bounds.
    rows = sorted(bins.collect())
    yes, no = (np.asarray([r[i] for r in rows], float) for i in (1, 2))
    if not (yes.sum() and no.sum()):
        model.cut = 0.0
        return model
    missed = np.concatenate([[0], np.cumsum(yes)]) / yes.sum()
    passed = 1 - np.concatenate([[0], np.cumsum(no)]) / no.sum()
    cuts = [*(r[0] / STEPS_PER_UNIT for r in rows), (rows[-1][0] + 1) / STEPS_PER_UNIT]
    error = missed + passed
    model.cut = min((cuts[i] for i in np.flatnonzero(error <= error.min() + 1e-12)), key=abs)
    return model


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the chunks of sorted URLs; a chunk is full with ``CHUNK_BYTES``."""
    chunk, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        chunks = np.zeros(batch.num_rows, np.int64)
        for i, url in enumerate(_bytes(batch["url"])):
            if held >= CHUNK_BYTES:
                chunk, held = chunk + 1, 0
            chunks[i] = chunk
            held += len(url) + 1
        yield pa.RecordBatch.from_arrays([pa.array(chunks), batch["url"]], names=["chunk", "url"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct keys of every chunk; a chunk that batches cut may ask twice."""
    for batch in batches:
        chunks = batch["chunk"].to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
        for start, end in zip(bounds[:-1], bounds[1:]):
            if start < end:
                _, _, keys = _places(_bytes(batch["url"].slice(start, end - start)), ORDER)
                used = np.unique(np.concatenate([k for pair in keys for k in pair]))
                columns = [pa.array(np.full(len(used), chunks[start])), pa.array(used)]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "key"])


def _answered(urls: pa.Table, found: pa.Table) -> pa.Table:
    """Scores of one chunk's URLs from the counts of its keys."""
    known, counts = np.zeros(0, np.int64), np.zeros((2, 0))
    if found.num_rows:
        found = found.sort_by("key")
        known = found["key"].to_numpy()
        counts = np.array([found["no"].to_numpy(), found["yes"].to_numpy()], float)
    return pa.table({"url": urls["url"], "score": scores(_bytes(urls["url"]), known, counts)})


def score(urls: DataFrame, model: Ratio, url_col: str) -> DataFrame:
    """Add ``score``, the log ratio per byte, above 0 where the accepted model is likelier."""
    kept = [c for c in urls.columns if c != "score"]
    if model.table is None:
        return urls.select(*kept, F.lit(0.0).alias("score"))
    rows = urls.select(*kept, F.coalesce(urls[url_col], F.lit("")).alias("__url"))
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select(F.col("__url").alias("url")).distinct().repartitionByRange(parts, "url").sortWithinPartitions("url")
    chunks = materialised(ordered.mapInArrow(_chunked, "chunk long, url string"))
    # Merged: by size estimates a chunk's keys are no larger than its URLs, so Spark would send many times its
    # limit through the driver.
    asked = chunks.mapInArrow(_asked, "chunk long, key long").hint("merge")
    found = asked.join(model.table, "key").select("chunk", "key", "no", "yes")
    scored = chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_answered, "url string, score double")
    own = scored.withColumnRenamed("url", "__scored")
    return rows.join(own.hint("merge"), F.col("__url") == F.col("__scored"), "left").select(*kept, "score")


def judge(
    pages: DataFrame,
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """Add ``host, path, rule, score, verdict``; the rules' own verdicts label the models' URLs."""
    ruled = with_rule(pages, url_col, rules)
    model = fit(ruled.withColumn("accepted", F.col("ruled") == "allow"), url_col, "accepted")
    scored = score(ruled, model, url_col)
    by_model = F.when(F.col("score") >= F.lit(model.cut), "allow").otherwise("block")
    return scored.withColumn("verdict", F.coalesce("ruled", by_model)).drop("ruled")
