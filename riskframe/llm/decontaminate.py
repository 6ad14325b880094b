"""Benchmark passages in documents, found by one scan with an Aho-Corasick automaton.

Texts are normalised to lower-case words a space apart.  Every run of ``window`` words of a benchmark
item, and every shorter item as a whole, is a pattern of the automaton; a document is scanned once, as
a whole, and the words inside any match are mapped back to character offsets of the original text.

The automaton travels by broadcast, so the benchmark text behind one is bounded by
``automaton_bytes``.  A larger benchmark is dealt to as many automata as that takes, one scan of the
documents each, and the spans found are merged per row; that needs documents that come from a stored
table, so that a row has the same number in each scan.

Defined results: a null text has no words and no hits; so have texts without a word; an item without
words or with a null identifier has no windows; items that repeat count once by identifier; without
documents there are no rows, and without items no hits.  The result column replaces one of its name.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import slices

WINDOW = 10
AUTOMATON_BYTES = 512 << 10
RESULT = "contamination"

#: Separators become spaces and A-Z lower case, byte by byte; bytes above 127 belong to words.
_NORMAL = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")

_TYPE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [T.StructField(n, T.LongType()) for n in ("first_word", "last_word", "start", "end")]
                )
            ),
        ),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def normal(text: str | None) -> bytes:
    """Lower-case words of ``text``, a space apart."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(_NORMAL).split())


class Matcher:
    """Automaton over the word windows of ``(identifier, text)`` items."""

    def __init__(self, items: Sequence[tuple[str, str]], window: int) -> None:
        import ahocorasick

        owners: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            words = normal(text).split()
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners[b" ".join(words[i : i + window])].add(item)
        self._automaton = ahocorasick.Automaton()
        for words, who in owners.items():
            pattern = words.decode("latin-1")
            self._automaton.add_word(f" {pattern} ", (pattern.count(" ") + 1, who))
        self._empty = not owners
        if owners:
            self._automaton.make_automaton()

    def scan(self, text: str | None) -> dict:
        words = normal(text)
        n_words = words.count(b" ") + 1 if words else 0
        found, items, runs = [], set(), []
        if words and not self._empty:
            line = f" {words.decode('latin-1')} "
            found = self._automaton.iter(line)
        at = before = 0
        for end, (size, who) in found:
            before += line.count(" ", at, end)
            at = end
            first, last = before - size, before - 1
            items |= who
            while runs and first <= runs[-1][1] + 1:
                earlier = runs.pop()
                first, last = min(first, earlier[0]), max(last, earlier[1])
            runs.append((first, last))
        spans = []
        if runs:
            places = [m.span() for m in _WORD.finditer(text)]
            spans = [
                {"first_word": a, "last_word": b, "start": places[a][0], "end": places[b][1]} for a, b in runs
            ]
        n_hit = sum(b - a + 1 for a, b in runs)
        return {"n_words": n_words, "n_hit": n_hit, "spans": spans, "items": sorted(items)}


_matchers: dict[str, Matcher] = {}


def _one_scan(docs: DataFrame, text: str, keep: Sequence[str], items: list, window: int) -> DataFrame:
    sent, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    kept = T.StructType([docs.schema[c] for c in keep])
    schema = T.StructType([*kept.fields, T.StructField(RESULT, _TYPE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        if key not in _matchers:  # one automaton per worker process at a time
            _matchers.clear()
            _matchers[key] = Matcher(sent.value, window)
        matcher, name = _matchers[key], text if text in keep else "__text"
        for batch in batches:
            for part in slices(batch, name):
                found = [matcher.scan(t) for t in part[name].to_pylist()]
                columns = [*(part[c] for c in keep), pa.array(found, to_arrow_type(_TYPE))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    sent_once = [] if text in keep else [docs[text].alias("__text")]
    rows = docs.select(*[docs[c] for c in keep], *sent_once)
    return rows.mapInArrow(run, schema)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    keep: Sequence[str] | None = None,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``contamination``.

    That struct holds the number of words, of words hit, the merged spans of hit words with their
    character offsets in the original (``end`` is exclusive), and the items with occurring windows,
    sorted as strings.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != RESULT]
    items = benchmark.select(
        benchmark[item_col].cast("string").alias("item"), benchmark[item_text_col].alias("text")
    ).dropna()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // automaton_bytes))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    if parts == 1:
        found = [tuple(r)[:2] for r in dealt.collect()]
        return _one_scan(docs, text_col, keep, found, window)
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    scans = [
        _one_scan(
            rows,
            text_col,
            [*keep, "__row"],
            [tuple(r)[:2] for r in dealt.filter(F.col("part") == i).collect()],
            window,
        )
        for i in range(parts)
    ]
    whole = scans[0].select("__row", *keep, F.col(f"{RESULT}.n_words").alias("__n"))
    hit = [s.filter(F.col(f"{RESULT}.n_hit") > 0).select("__row", RESULT) for s in scans]
    merged = (
        reduce(DataFrame.unionByName, hit)
        .groupBy("__row")
        .agg(
            F.flatten(F.collect_list(f"{RESULT}.spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{RESULT}.items")))).alias("items"),
        )
        .withColumn("spans", _merged_spans(F.col("spans")))
    )
    no_spans, no_items = F.array().cast(_TYPE["spans"].dataType), F.array().cast(_TYPE["items"].dataType)
    spans = F.coalesce("spans", no_spans)
    hits = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return whole.join(merged, "__row", "left").select(
        *keep,
        F.struct(
            F.col("__n").alias("n_words"),
            hits.alias("n_hit"),
            spans.alias("spans"),
            F.coalesce("items", no_items).alias("items"),
        ).alias(RESULT),
    )


def _merged_spans(spans):
    """Sort spans and join those that touch."""

    def add(done, s):
        last = F.element_at(done, -1)
        joined = F.struct(
            last["first_word"].alias("first_word"),
            F.greatest(last["last_word"], s["last_word"]).alias("last_word"),
            last["start"].alias("start"),
            F.greatest(last["end"], s["end"]).alias("end"),
        )
        rest = F.slice(done, 1, F.size(done) - 1)
        touch = (F.size(done) > 0) & (s["first_word"] <= F.get(done, F.size(done) - 1)["last_word"] + 1)
        return F.when(touch, F.concat(rest, F.array(joined))).otherwise(F.concat(done, F.array(s)))

    empty = F.array().cast(_TYPE["spans"].dataType)
    return F.aggregate(F.array_sort(spans), empty, add)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a word of the benchmark's windows, in their own columns."""
    columns = docs.columns
    return scan(docs, benchmark, **options).filter(F.col(f"{RESULT}.n_hit") == 0).select(*columns)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(<id_col>, n_words, n_hit, n_items, items_sha256, contaminated)`` of scanned documents."""
    found = F.col(RESULT)
    return scanned.select(
        id_col,
        found["n_words"].alias("n_words"),
        found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", found["items"]).cast("binary"), 256).alias("items_sha256"),
        (found["n_hit"] > 0).alias("contaminated"),
    )
