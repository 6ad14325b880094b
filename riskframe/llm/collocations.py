"""Collocations from FM-indexes over word numbers, one index per shard, summed across shards.

*Shards.*  Texts are cut into pieces and words where they are read; every ``SHARD_WORDS`` words of a
task become a shard: word numbers with a 0 between pieces, and the words they stand for.

*Index.*  ``BiIndex`` holds the Burrows-Wheeler transforms of a shard and of its reverse.  A phrase is
a pair of intervals, one in each.  Extending it to the left by every word that stands there reads its
interval of the forward transform: equal words are counted, the mapping of the first of them gives the
longer phrase's interval there, and the number of smaller words gives its interval in the reverse
transform.  Extending to the right is the same with the two exchanged; phrases grow by turns on
either side.  Suffixes need to be sorted no deeper than the longest phrase.

*Counting.*  A phrase that reaches ``least`` in all shards together consists of words and of pairs that
do.  So words are counted first, other words become breaks, pairs are enumerated next, and longer
phrases only along pairs that reach it; each time shards get back what they hold of the survivors.
Nothing is dropped that could reach ``least``.

*Sums.*  Phrases are dealt to buckets by their hashes, and a shard sends each bucket one compressed
block: the phrases by column, and their counts.  A phrase is one entry per shard that has it, however
frequent it is, so buckets are even; there are as many as shuffle partitions, and more if they held
over ``BUCKET_WORDS`` words.  From the sums, a phrase as frequent as one that is a word longer, on its
left or on its right, occurs only inside that one.

*Scores.*  Every cut of a candidate looks up its two parts by joins; numbers are decimals of 38 digits
(1000 times two counts below 10^17 fits).

Defined results: a null text has no words, a null language is ``und``; repeated rows count each;
ties in score go to the higher count, then to the smaller phrase in UTF-8 byte order; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import slices
from riskframe.session import materialised

DEPTH = 5
LEAST = 100
TOP = 2000
SHARD_WORDS = 1 << 20
BUCKET_WORDS = 1 << 22
UNKNOWN = "und"
#: Pieces end at any of .,;:!? and at line ends; words at spaces and tabs.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_AS_READ = bytes.maketrans(_UPPER + _ENDS + b"\t", _UPPER.lower() + b"." * len(_ENDS) + b" ")
#: Text is taken in steps of about so many bytes, which end where a piece does.
STEP = 1 << 22

_SHARD = pa.schema(
    [
        ("shard", pa.int64()),
        ("lang", pa.string()),
        ("n", pa.int64()),
        ("numbers", pa.binary()),
        ("words", pa.binary()),
        ("counts", pa.binary()),
    ]
)
_WORDS = pa.schema([("bucket", pa.int64()), *(_SHARD.field(c) for c in ("shard", "lang", "numbers", "words", "counts"))])
_COUNTED = pa.schema(
    [
        ("lang", pa.string()),
        ("word", pa.string()),
        ("id", pa.int64()),
        ("f", pa.int64()),
        ("shard", pa.int64()),
        ("held", pa.binary()),
    ]
)
_BLOCK = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("block", pa.binary())])
_SUMMED = pa.schema([("words", pa.list_(pa.int64())), ("a", pa.int64()), ("shard", pa.int64()), ("pairs", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names.get(f.type, 'array<long>')}" for f in schema)


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _raw(squeezed: bytes) -> bytes:
    return pa.decompress(squeezed[8:], int.from_bytes(squeezed[:8], "little"), codec="zstd", asbytes=True)


def _stored(numbers: np.ndarray) -> bytes:
    """Numbers, compressed; all their first bytes, then all their second ones, and so on."""
    return _squeezed(np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _numbers(stored: bytes) -> np.ndarray:
    planes = np.frombuffer(_raw(stored), np.uint8).reshape(8, -1)
    return planes.T.copy().view("<i8").ravel()


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, of which the first ascends: its steps are stored."""
    return _stored(np.concatenate([np.diff(columns[0], prepend=0), *columns[1:]]))


def _unpacked(block: bytes, columns: int) -> np.ndarray:
    out = _numbers(block).reshape(columns, -1)
    out[0] = np.cumsum(out[0])
    return out


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(bucket, start, end)`` of each stretch of a sorted array."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for start, end in zip(starts.tolist(), np.append(starts[1:], len(bucket)).tolist()):
        yield int(bucket[start]), start, end


def _between_breaks(numbers: np.ndarray) -> np.ndarray:
    """The same pieces with one 0 between any two, at the start and at the end."""
    numbers = np.concatenate([[0], numbers, [0]])
    return numbers[np.append(True, (numbers[1:] != 0) | (numbers[:-1] != 0))]


class BiIndex:
    """A bidirectional FM-index of pieces of word numbers, for phrases of up to ``depth`` words.

    ``text`` has a 0 at its start, between its pieces and at its end.
    """

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self._symbols = int(text.max()) + 1
        self._counts = np.bincount(text, minlength=self._symbols)
        self._first = np.cumsum(self._counts) - self._counts
        #: What stands left of every suffix, and right of every reversed prefix, in sorted order.
        left = text[self._sorted(text, depth, 1) - 1]
        right = np.append(text, 0)[self._sorted(text, depth, -1) + 1]
        self._transforms = {"left": (left, self._mapping(left)), "right": (right, self._mapping(right))}

    def _sorted(self, text: np.ndarray, depth: int, step: int) -> np.ndarray:
        """Places by the ``depth`` words from there on (``step`` 1) or back (-1)."""
        bits = max(1, (self._symbols - 1).bit_length())
        some = 63 // bits
        keys = []
        for start in range(0, depth, some):
            key = np.zeros(len(text), np.int64)
            for i in range(start, min(start + some, depth)):
                key = (key << bits) | np.roll(text, -step * i)
            keys.append(key)
        return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])

    @staticmethod
    def _mapping(transform: np.ndarray) -> np.ndarray:
        """From the row of a suffix to that of the suffix one word longer."""
        mapped = np.empty(len(transform), np.int64)
        mapped[np.argsort(transform, kind="stable")] = np.arange(len(transform))
        return mapped

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words as phrases ``(words, start, start in the reverse, count)``."""
        found = np.flatnonzero(self._counts[1:]) + 1
        return found[:, None], self._first[found], self._first[found], self._counts[found]

    def extended(self, found, side: str):
        """All phrases of one more word on the ``left`` or ``right``."""
        phrases, start, back, count = found
        own, other = (start, back) if side == "left" else (back, start)
        transform, mapped = self._transforms[side]
        rows = np.arange(int(count.sum())) + np.repeat(own - (np.cumsum(count) - count), count)
        beside = np.repeat(np.arange(len(count)), count) * self._symbols + transform[rows]
        key, first, n = np.unique(beside, return_index=True, return_counts=True)
        parent, word = np.divmod(key, self._symbols)
        smaller = np.cumsum(n) - n
        opened = np.searchsorted(parent, parent)
        keep = word > 0
        own = mapped[rows[first]][keep]
        other = (other[parent] + smaller - smaller[opened])[keep]
        before, word = phrases[parent[keep]], word[keep]
        if side == "left":
            return np.column_stack([word, before]), own, other, n[keep]
        return np.column_stack([before, word]), other, own, n[keep]


def _shards(docs: DataFrame, lang: str, text: str, words: int) -> DataFrame:
    """One row per shard: its word numbers, its words from number 1 on, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[np.ndarray]] = defaultdict(list)
        known: dict[str, dict[bytes, int]] = {}
        held, made = 0, TaskContext.get().partitionId() << 32

        def full() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for name, parts in texts.items():
                numbers = np.concatenate(parts)
                counts = np.bincount(numbers, minlength=len(known[name]))[1:]
                # Frequent words get the small numbers, which compress best.
                order = np.argsort(-counts, kind="stable")
                again = np.zeros(len(counts) + 1, np.int64)
                again[order + 1] = np.arange(1, len(counts) + 1)
                spelt = np.array(list(known[name])[1:], object)[order]
                blocks = (_stored(_between_breaks(again[numbers])), _squeezed(b" ".join(spelt)), _stored(counts[order]))
                row = (made, name, int(counts.sum()), *blocks)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SHARD)], schema=_SHARD)
                made += 1
            texts.clear()
            known.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                raw = part["text"].cast(pa.binary()).to_pylist()
                for name, data in zip(part["lang"].to_pylist(), raw):
                    data, start = (data or b"").translate(_AS_READ), 0
                    while start < len(data):
                        end = data.find(b".", start + STEP) if len(data) > start + STEP else len(data)
                        end = len(data) if end < 0 else end
                        words_here = data[start:end].replace(b".", b" . ").split()
                        start = end
                        if name not in known:
                            known[name] = defaultdict(None, {b".": 0})
                            known[name].default_factory = known[name].__len__
                        number = known[name].__getitem__
                        size = len(words_here)
                        texts[name].append(np.fromiter(map(number, words_here), np.int64, size))
                        texts[name].append(np.zeros(1, np.int64))
                        held += size
                        if held >= words:
                            yield from full()
                            held = 0
        yield from full()

    rows = docs.select(F.coalesce(docs[lang], F.lit(UNKNOWN)).alias("lang"), docs[text].alias("text"))
    return rows.mapInArrow(run, _ddl(_SHARD))


def _word_blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Each shard's words, dealt to buckets: ``numbers`` says which words of the shard they are."""
    for batch in batches:
        for row in batch.to_pylist():
            counts = _numbers(row["counts"])
            if not len(counts):
                continue
            words = np.array(_raw(row["words"]).split(b" "), object)
            hashed = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
            bucket = _mixed([hashed]).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            out = []
            for at, start, end in _runs(bucket[order]):
                own = order[start:end]
                block = (_packed([own + 1]), _squeezed(b" ".join(words[own])), _stored(counts[own]))
                out.append((at, row["shard"], row["lang"], *block))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _WORDS)], schema=_WORDS)


def _counted_words(group: pa.Table, least: int, buckets: int) -> pa.Table:
    """A bucket's words that reach ``least``, each with a number of its own, and which of them shards hold."""
    out, bucket, made = [], group["bucket"][0].as_py(), 0
    by_lang = defaultdict(list)
    for row in group.drop_columns(["bucket"]).to_pylist():
        by_lang[row["lang"]].append(row)
    for lang in sorted(by_lang):
        rows = by_lang[lang]
        words = [_raw(row["words"]).split(b" ") for row in rows]
        coded = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
        code = coded.indices.to_numpy()
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, code, np.concatenate([_numbers(row["counts"]) for row in rows]))
        kept = np.flatnonzero(total >= least)
        kept = kept[np.argsort(-total[kept], kind="stable")]
        ids = np.zeros(len(total), np.int64)
        # Numbers count up in all buckets at once, so they stay small.
        ids[kept] = (made + np.arange(len(kept))) * buckets + bucket + 1
        made += len(kept)
        names = coded.dictionary.take(pa.array(kept)).cast(pa.string()).to_pylist()
        out += [(lang, *row, None, None) for row in zip(names, ids[kept].tolist(), total[kept].tolist())]
        own = ids[code]
        ends = np.cumsum([len(w) for w in words])
        for row, start, end in zip(rows, ends - [len(w) for w in words], ends):
            some = own[start:end] > 0
            if some.any():
                held = [_unpacked(row["numbers"], 1)[0][some], own[start:end][some]]
                out.append((lang, None, None, None, row["shard"], _packed(held)))
    columns = list(zip(*out)) if out else [[]] * len(_COUNTED)
    return pa.table([pa.array(x, f.type) for x, f in zip(columns, _COUNTED)], schema=_COUNTED)


def _pruned(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A shard's word numbers with only the words that go on, numbered anew, and their identifiers."""
    numbers = _numbers(left["numbers"][0].as_py())
    number, ids = np.concatenate([_unpacked(x, 2) for x in right["held"].to_pylist() if x is not None], axis=1)
    order = np.argsort(number)
    again = np.zeros(max(int(numbers.max()), int(number.max())) + 1, np.int64)
    again[number[order]] = np.arange(1, len(order) + 1)
    return _between_breaks(again[numbers]), ids[order]


def _blocks(shard: int, columns: list[np.ndarray], keys: int, buckets: int) -> list[tuple[int, int, bytes]]:
    """Entries dealt to buckets by the hash of their first ``keys`` columns."""
    if not len(columns[0]):
        return []
    bucket = (_mixed(columns[:keys]) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((columns[0], bucket))
    columns = [c[order] for c in columns]
    return [(at, shard, _packed([c[start:end] for c in columns])) for at, start, end in _runs(bucket[order])]


def _as_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.table([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def _pair_blocks(left: pa.Table, right: pa.Table, buckets: int) -> pa.Table:
    """A shard's pairs of words that go on, and their counts."""
    if not left.num_rows or not right.num_rows:
        return _BLOCK.empty_table()
    text, ids = _pruned(left, right)
    index, known = BiIndex(text, 2), np.append(0, ids)
    pairs, _, _, count = index.extended(index.words(), "right")
    columns = [known[pairs[:, 0]], known[pairs[:, 1]], count]
    return _as_table(_blocks(left["shard"][0].as_py(), columns, 2, buckets), _BLOCK)


def _entries(group: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a bucket, a row each, and the place of each entry's block in ``group``."""
    blocks = [_unpacked(x, columns) for x in group["block"].to_pylist()]
    owner = np.repeat(np.arange(len(blocks)), [x.shape[1] for x in blocks])
    return np.concatenate(blocks, axis=1), owner


def _grouped(entries: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by the first ``keys`` columns, and where each phrase starts in it."""
    order = np.lexsort(entries[:keys][::-1])
    sorted_keys = entries[:keys, order]
    fresh = np.append(True, (sorted_keys[:, 1:] != sorted_keys[:, :-1]).any(axis=0))
    return order, np.flatnonzero(fresh)


def _counted_pairs(group: pa.Table, least: int) -> pa.Table:
    """A bucket's pairs that reach ``least``, and which of them shards hold."""
    entries, owner = _entries(group, 3)
    order, starts = _grouped(entries, 2)
    total = np.add.reduceat(entries[2, order], starts)
    kept = total >= least
    out = [(pair, a, None, None) for pair, a in zip(entries[:2, order[starts[kept]]].T.tolist(), total[kept].tolist())]
    alive = np.empty(len(order), bool)
    alive[order] = np.repeat(kept, np.diff(np.append(starts, len(order))))
    shards = group["shard"].to_pylist()
    pairs = entries[:2, alive]
    for at, start, end in _runs(owner[alive]):
        out.append((None, None, shards[at], _packed(list(pairs[:, start:end]))))
    return _as_table(out, _SUMMED)


def _longer_blocks(left: pa.Table, right: pa.Table, depth: int, buckets: int) -> pa.Table:
    """A shard's phrases of three to ``depth`` words along the pairs that go on."""
    blocks = [x for x in right["pairs"].to_pylist() if x is not None]
    if not left.num_rows or not blocks:
        return _BLOCK.empty_table()
    text, ids = _pruned(left, right)
    symbols = len(ids) + 1
    order = np.argsort(ids)
    pairs = np.concatenate([_unpacked(x, 2) for x in blocks], axis=1)
    first, second = order[np.searchsorted(ids[order], pairs)] + 1
    goes_on = np.append(np.isin(text[:-1] * symbols + text[1:], first * symbols + second), False)
    triple = goes_on & np.append(goes_on[1:], False)
    goes_on &= triple | np.append(False, triple[:-1])
    stays = goes_on | np.append(False, goes_on[:-1])
    chain = np.column_stack([text, np.zeros(len(text), np.int64)])
    chain = _between_breaks(chain[np.column_stack([stays, ~goes_on])])
    if not chain.any():
        return _BLOCK.empty_table()
    index, known = BiIndex(chain, depth), np.append(0, ids)
    found, columns = index.extended(index.words(), "right"), []
    for size in range(3, depth + 1):
        found = index.extended(found, "left" if size % 2 else "right")
        phrases, _, _, count = found
        words = [known[phrases[:, i]] if i < size else np.zeros(len(count), np.int64) for i in range(depth)]
        columns.append([*words, count])
    columns = [np.concatenate(c) for c in zip(*columns)]
    return _as_table(_blocks(left["shard"][0].as_py(), columns, depth, buckets), _BLOCK)


def _counted_longer(group: pa.Table, depth: int, least: int) -> pa.Table:
    """A bucket's phrases that reach ``least``."""
    entries, _ = _entries(group, depth + 1)
    order, starts = _grouped(entries, depth)
    total = np.add.reduceat(entries[depth, order], starts)
    kept = total >= least
    rows = zip(entries[:depth, order[starts[kept]]].T.tolist(), total[kept].tolist())
    return _as_table([([w for w in own if w], a, None, None) for own, a in rows], _SUMMED)


def _with_sides(phrases: DataFrame) -> DataFrame:
    """Add ``inside``: an extension by one word, on the left or on the right, is as frequent."""
    longer = phrases.filter(F.size("words") > 1)
    last = F.expr("slice(words, 1, size(words) - 1)")
    parts = longer.select(F.explode(F.array(last, F.expr("slice(words, 2, size(words) - 1)"))).alias("part"), "a")
    most = parts.groupBy("part").agg(F.max("a").alias("most"))
    found = phrases.join(most, F.col("words") == F.col("part"), "left")
    return found.select("words", "a", F.coalesce(F.col("most") == F.col("a"), F.lit(False)).alias("inside"))


def frequent_phrases(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = LEAST,
    depth: int = DEPTH,
    shard_words: int = SHARD_WORDS,
    bucket_words: int = BUCKET_WORDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(words, phrases, totals)``, stored.

    ``words (id, lang, word, f)`` and ``phrases (words, a, inside)`` occur ``least`` times or more; a
    phrase of 1 to ``depth`` words is an array of identifiers; ``inside``: it never occurs but inside a
    longer one of them.  ``totals (lang, n)``
    counts all occurrences of words.
    """
    if depth < 2:
        raise ValueError("phrases have two words or more")
    shards = materialised(_shards(docs, lang_col, text_col, shard_words))
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    all_words = shards.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-all_words // bucket_words))

    # Shuffled rows are single blocks, so every word and phrase is sent once per shard that has it.
    dealt = shards.select("shard", "lang", "words", "counts").mapInArrow(
        lambda batches: _word_blocks(batches, buckets), _ddl(_WORDS)
    )
    counted = dealt.groupBy("bucket").applyInArrow(lambda group: _counted_words(group, least, buckets), _ddl(_COUNTED))
    counted = materialised(counted)
    words = counted.filter("word is not null").select("id", "lang", "word", "f")
    held = counted.filter("word is null").select(F.col("shard").alias("own"), "held")
    whole = shards.select("shard", "numbers").groupBy("shard")
    dealt = whole.cogroup(held.groupBy("own")).applyInArrow(
        lambda left, right: _pair_blocks(left, right, buckets), _ddl(_BLOCK)
    )
    summed = dealt.groupBy("bucket").applyInArrow(lambda group: _counted_pairs(group, least), _ddl(_SUMMED))
    summed = materialised(summed)
    phrases = words.select(F.array("id").alias("words"), F.col("f").alias("a"))
    phrases = phrases.unionByName(summed.filter("words is not null").select("words", "a"))
    if depth > 2:
        pairs = summed.filter("words is null").select(F.col("shard").alias("own"), "pairs")
        both = held.withColumn("pairs", F.lit(None).cast("binary")).unionByName(
            pairs.withColumn("held", F.lit(None).cast("binary"))
        )
        dealt = whole.cogroup(both.groupBy("own")).applyInArrow(
            lambda left, right: _longer_blocks(left, right, depth, buckets), _ddl(_BLOCK)
        )
        found = dealt.groupBy("bucket").applyInArrow(lambda group: _counted_longer(group, depth, least), _ddl(_SUMMED))
        phrases = phrases.unionByName(materialised(found.select("words", "a")))
    return words, materialised(_with_sides(phrases)), totals


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = LEAST,
    depth: int = DEPTH,
    top: int = TOP,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of every language.

    A candidate's score is that of its worst cut into two parts, ``floor(1000 a n / (l r))``; one that
    occurs only inside a longer candidate is left out.
    """
    words, phrases, totals = frequent_phrases(docs, lang_col, text_col, least, depth, shard_words)
    found = phrases.filter(~F.col("inside") & (F.size("words") > 1)).select("words", "a")
    cuts = found.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "words", "a", "k",
        F.expr("slice(words, 1, k)").alias("first"), F.expr("slice(words, k + 1, size(words) - k)").alias("rest"),
    )
    first = phrases.select(F.col("words").alias("first"), F.col("a").alias("l"))
    rest = phrases.select(F.col("words").alias("rest"), F.col("a").alias("r"))
    spelt = (
        found.select("words", F.posexplode("words").alias("at", "id"))
        .join(words.select("id", "lang", "word"), "id")
        .groupBy("words")
        .agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelling"))
        .select("words", "lang", F.concat_ws(" ", F.col("spelling.word")).alias("phrase"))
    )
    score = F.expr(
        "(cast(a as decimal(18,0)) * cast(n as decimal(18,0)) * cast(1000 as decimal(4,0)))"
        " div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    )
    scored = cuts.join(first, "first").join(rest, "rest").join(spelt, "words").join(totals, "lang")
    worst = (
        scored.groupBy("words")
        .agg(F.min(F.struct(score.alias("score"), "k", "lang", "phrase", "a", "l", "r", "n")).alias("worst"))
        .select("worst.*")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = worst.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
