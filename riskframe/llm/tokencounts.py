"""How many tokens a byte-pair model makes of each text, without making the tokens.

A pre-token is a linked list of symbols and a heap of its adjacent pairs by rank.  The pair of lowest
rank, the leftmost of equals, is merged again and again; what it formed with its neighbours becomes
stale in the heap and what it forms now is pushed.  The count is the number of symbols at the start
less the number of merges: no identifier is looked up or passed on.

Texts are cut at ASCII white space, where the normaliser and the pre-tokenizer of the vocabulary cut
anyway; the count of a part seen before comes from a cache of bounded size per worker.

Defined results: a null text is an empty one and has no bytes and no tokens; strings of special
tokens inside a text count one each, as the library has it by default; there is no longest text or
word; repeated rows and null identifiers each give a row; an empty table gives no rows; further
columns of the input are ignored unless named in ``keep``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskframe.llm.common import slices

WORD_BPE = "word_bpe_49k.json"
LIMIT = 2048
CACHE_PARTS = 1_000_000
#: Longer parts are rare and not worth a place in the cache.
CACHED_BYTES = 64

_counters: dict[str, MergeCounter] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def counter(path: str) -> MergeCounter:
    """One counter per worker process and file."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def left_after_merging(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """The number of symbols left when no adjacent pair has a rank any more."""
    n = len(symbols)
    heap = [(ranks[pair], i) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
    if not heap:
        return n
    heapify(heap)
    left = n
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        # A symbol merged into its neighbour is None, so that its pairs have no rank.
        if j >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        symbols[j] = None
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            fresh = ranks.get((symbols[i], symbols[k]))
            if fresh is not None:
                heappush(heap, (fresh, i))
        h = before[i]
        if h >= 0:
            fresh = ranks.get((symbols[h], symbols[i]))
            if fresh is not None:
                heappush(heap, (fresh, h))
    return left


class MergeCounter:
    """Token counts of texts under one vocabulary file of the ``tokenizers`` library.

    The file's own normaliser and pre-tokenizer see every part that is not plain ASCII; for plain
    ASCII parts their rules are followed here.  A vocabulary must be a byte-level BPE whose
    pre-tokens hold no white space and whose special tokens are matched in the raw text.
    """

    #: The pre-tokenizer's pattern, for lower-case ASCII without white space.
    _ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("the vocabulary is not a plain byte-pair model")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("special tokens must be matched as they are in the raw text")
        self._ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self._end = model.get("end_of_word_suffix") or ""
        names = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self._special = re.compile(b"(" + b"|".join(map(re.escape, names)) + b")") if names else None
        library = Tokenizer.from_file(path)
        self._normalizer, self._pre_tokenizer = library.normalizer, library.pre_tokenizer
        self._words: dict[str, int] = {}
        self._parts: dict[bytes, int] = {}

    def _word(self, word: str) -> int:
        """Tokens of one pre-token, which is spelt with a character per byte."""
        known = self._words.get(word)
        if known is None:
            symbols = list(word)
            symbols[-1] += self._end
            known = left_after_merging(symbols, self._ranks)
            if len(word) <= CACHED_BYTES:
                self._words[word] = known
        return known

    def _plain(self, part: bytes) -> int:
        """Tokens of a part without special tokens."""
        text = part.decode("utf-8", "replace")
        if part.isascii() and text.isprintable():
            words = self._ASCII.findall(text.lower())
        else:
            clean = self._normalizer.normalize_str(text)
            words = [word for word, _ in self._pre_tokenizer.pre_tokenize_str(clean)]
        return sum(map(self._word, words))

    def _part(self, part: bytes) -> int:
        if self._special is None or not self._special.search(part):
            return self._plain(part)
        pieces = self._special.split(part)
        return sum(map(self._plain, filter(None, pieces[::2]))) + len(pieces) // 2

    def _make_room(self, parts: set[bytes]) -> None:
        """Halve the caches before they outgrow their bound, but keep what ``parts`` need."""
        if len(self._words) > CACHE_PARTS:
            self._words.clear()
        if len(self._parts) + len(parts) > CACHE_PARTS:
            # Frequent parts came early, and a dictionary keeps that order.
            kept = dict(islice(self._parts.items(), CACHE_PARTS // 2))
            kept.update((part, self._parts[part]) for part in parts if part in self._parts)
            self._parts.clear()
            self._parts.update(kept)

    def count(self, texts: list[bytes]) -> list[int]:
        """The number of tokens of every text, given as UTF-8."""
        known, counts = self._parts, []
        for text in texts:
            parts = text.split()
            distinct = set(parts)
            missing = distinct.difference(known)
            if missing:
                self._make_room(distinct)
                known.update((part, self._part(part)) for part in missing)
            counts.append(sum(map(known.__getitem__, parts)))
            for part in missing:
                if len(part) > CACHED_BYTES:
                    del known[part]
        return counts


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = LIMIT,
    tokenizer: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(<id_col>, *keep, n_bytes, n_tokens, over_limit)`` of every row's whole text.

    No shuffle: a scan, one pass of Arrow batches, and nothing but numbers goes back.
    """
    vocabulary = tokenizer or default_path()
    kept = [id_col, *keep]
    schema = T.StructType([docs.schema[name] for name in kept])
    for name, kind in (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = [t or b"" for t in part["__text"].cast(pa.binary()).to_pylist()]
                counts = pa.array(counter(vocabulary).count(texts), pa.int64())
                sizes = pa.array([len(t) for t in texts], pa.int64())
                over = pa.compute.greater(counts, pa.scalar(limit, pa.int64()))
                columns = [part[i] for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, sizes, counts, over], names=schema.names)

    rows = docs.select(*kept, docs[text_col].alias("__text"))
    return rows.mapInArrow(run, schema)
