"""Whole texts to token ids, with the words seen before kept at hand."""

from __future__ import annotations

import re
from codecs import charmap_decode
from collections.abc import Iterator, Sequence
from itertools import chain, filterfalse, islice
from string import punctuation

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"
CACHE_WORDS = 500_000
JOINED = 64
#: Runs of punctuation whose ids are kept.
STOPS = 10_000
#: Bytes of text whose words are looked up at once; that takes some 50 times as much memory.
TOGETHER = 500_000

_AFTER_BLANK = re.compile(r"\s ")
_BREAK = re.compile(r"(?<=\S) ")
_BLANK = re.compile(r"\s")
_LINES = re.compile(r"\S+(?:\n\S+)+")
#: Byte-level models name a byte by its own character where that prints, by one from 256 on where not.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_AS_PRINTED = {b: 256 + i for i, b in enumerate(_HIDDEN)}
_PRINTED = "".join(chr(_AS_PRINTED.get(b, b)) for b in range(256))
_BASE, _ONE = np.uint64(0x100000001B3), np.uint64(1)
#: 1 divided by ``_BASE``, modulo 2 ** 64.
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_HEAD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = chr(_AS_PRINTED[32])
_encoders: dict[str, Encoder] = {}
_kept_powers: dict[np.uint64, np.ndarray] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(BYTE_BPE)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """At least the first ``n`` powers, kept for the next call unless a long text needs more of them."""
    kept = _kept_powers.get(base)
    if kept is not None and len(kept) >= n:
        return kept
    powers = np.full(max(n, 2 * TOGETHER), base)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    if n <= 2 * TOGETHER:
        _kept_powers[base] = powers
    return powers


def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """One encoder per worker process and file; the cache's bound is that of the latest call."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].cache_words = cache_words
    return _encoders[path]


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, equal to encoding each text whole.

    A special token's string in a text is that token, as the library has it by default; the text is cut
    there first.
    Byte-level pre-tokenising never joins a space to the word before it, so a text may be cut
    before each space that follows something other than white space.  The parts repeat: each is
    encoded by the tokenizer once while it stays in the cache.  A part without inner white space is
    encoded together with many others, a newline apart, since a newline between words is always one
    id of its own; any other part is encoded by itself.  Words of letters alone, which are one
    pre-token each, go to the tokenizer's model directly, and punctuation after them, one more, apart.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.cache_words = CACHE_WORDS
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        added = self._tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("special tokens must be matched as they are in the raw text")
        self._special = {t.content: np.asarray([i], "<u4").tobytes() for i, t in added.items()}
        names = sorted(self._special, key=len, reverse=True)
        self._cut = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else None
        self._id = [i.to_bytes(4, "little") for i in range(self._tokenizer.get_vocab_size())]
        self._known_stops: dict[str, bytes] = {"": b""}
        self._line = self._whole("\n")
        (self._newline,) = np.frombuffer(self._line, "<u4")
        self._spaced: dict[str, bytes] = {}
        self._first: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def _letters(self, lead: str, word: str) -> bytes:
        """Letters, with or without a space before them, are one pre-token: the model's own input."""
        if not word.isascii():
            word = charmap_decode(word.encode(), "strict", _PRINTED)[0]
        parts = self._model.tokenize(_SPACE + word if lead else word)
        if len(parts) == 1:
            return self._id[parts[0].id]
        return b"".join([self._id[part.id] for part in parts])

    def _stops(self, stops: str) -> bytes:
        ids = self._known_stops.get(stops)
        if ids is None:
            ids = self._whole(stops)
            if len(self._known_stops) < STOPS:
                self._known_stops[stops] = ids
        return ids

    def _fill(self, cache: dict[str, bytes], lists: list[list[str]], lead: str, keep: Sequence[list[str]] = ()) -> None:
        """Have ``cache`` hold all words of ``lists``, each encoded with ``lead`` before it; those of ``keep`` stay."""
        missing = set(filterfalse(cache.__contains__, chain.from_iterable(lists)))
        if len(cache) + len(missing) > self.cache_words:
            # Frequent words came early, and a dictionary keeps that order.
            kept = dict(islice(cache.items(), self.cache_words // 2))
            kept.update((word, cache[word]) for word in chain(*lists, *keep) if word in cache)
            cache.clear()
            cache.update(kept)
        plain, lines = [], []
        letters = self._letters
        for word in missing:
            if word.isalpha():
                cache[word] = letters(lead, word)
                continue
            stem = word.rstrip(punctuation)
            if stem.isalpha():
                ids = cache.get(stem) or letters(lead, stem)
                cache[word] = ids + self._stops(word[len(stem) :])
            elif "\n" in word and _LINES.fullmatch(word):
                lines.append(word)
            elif not word or _BLANK.search(word):
                cache[word] = self._whole(lead + word)
            else:
                plain.append(word)
        for i in range(0, len(plain), JOINED):
            some = plain[i : i + JOINED]
            joined = "".join(lead + word + "\n" for word in some)
            ids = np.frombuffer(self._whole(joined), "<u4")
            ends = np.flatnonzero(ids == self._newline)
            if len(ends) != len(some):
                cache.update((word, self._whole(lead + word)) for word in some)
                continue
            starts = [0, *(ends[:-1] + 1).tolist()]
            for word, start, end in zip(some, starts, ends.tolist()):
                cache[word] = ids[start:end].tobytes()

        if lines:
            # A line end between words is one id of its own, and what follows has no space before it.
            split = [word.split("\n") for word in lines]
            self._fill(cache, [[parts[0] for parts in split]], lead, [*lists, *keep])
            heads = [cache[parts[0]] for parts in split]
            self._fill(self._first, [parts[1:] for parts in split], "", [*lists, *keep] if cache is self._first else ())
            for word, head, parts in zip(lines, heads, split):
                cache[word] = self._line.join([head, *map(self._first.__getitem__, parts[1:])])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text."""
        held = [i for i, text in enumerate(texts) if any(name in text for name in self._special)]
        if not held:
            return self._encode(texts)
        pieces = {i: self._cut(texts[i]) for i in held}
        plain = iter(self._encode([text for i, text in enumerate(texts) for text in pieces.get(i, [text])[::2]]))
        out = []
        for i in range(len(texts)):
            own = pieces.get(i, [""])
            ids = [next(plain)]
            for name in own[1::2]:
                ids += [self._special[name], next(plain)]
            out.append(b"".join(ids))
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        # Only spaces that follow white space need care.
        odd = [i for i, text in enumerate(texts) if _AFTER_BLANK.search(text)]
        found = dict(zip(odd, self._by_parts([_BREAK.split(texts[i]) for i in odd])))
        rest = self._grouped([text.encode() for i, text in enumerate(texts) if i not in found])
        return [found[i] if i in found else next(rest) for i in range(len(texts))]

    def _grouped(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of texts that may be cut before every space, some ``TOGETHER`` bytes at a time."""
        start = held = 0
        for end, text in enumerate(texts, 1):
            held += len(text)
            if held >= TOGETHER or end == len(texts):
                yield from self._by_words(texts[start:end])
                start, held = end, 0

    def _by_parts(self, parts: list[list[str]]) -> list[bytes]:
        """The ids of texts that are given in parts, each but the first to have a space before it."""
        heads = [p.pop(0) for p in parts]
        self._fill(self._first, [heads], "")
        opened = [self._first[head] for head in heads]
        self._fill(self._spaced, parts, " ")
        known = self._spaced.__getitem__
        return [head + b"".join(map(known, p)) for head, p in zip(opened, parts)]

    def _by_words(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts that may be cut before every space.

        All texts at once: a word is looked up once, however often it occurs, and the ids are put
        together by its occurrences.  Equal words are found by their hashes and then compared.
        """
        whole = b" " + b" ".join(texts)
        raw = np.frombuffer(whole, np.uint8)
        starts = np.flatnonzero(raw == 32)
        sizes = np.diff(np.append(starts, len(raw)))
        counts = np.fromiter((text.count(b" ") + 1 for text in texts), np.int64, len(texts))
        firsts = np.cumsum(counts) - counts
        # A word's hash adds up its bytes by powers of their places, and is brought back to the word's start.
        hashed = raw + _ONE
        hashed *= _powers(_BASE, len(raw))[: len(raw)]
        hashed = np.add.reduceat(hashed, starts) * _powers(_UNBASE, len(raw))[starts]
        hashed ^= sizes.astype(np.uint64) << np.uint64(48)
        hashed[firsts] ^= _HEAD
        distinct, shown, which = np.unique(hashed, return_index=True, return_inverse=True)
        head = np.zeros(len(starts), bool)
        head[firsts] = True
        there = np.repeat(starts[shown][which] - starts, sizes)
        there += np.arange(len(raw))
        if (sizes != sizes[shown][which]).any() or (head != head[shown][which]).any() or (raw != raw[there]).any():
            return self._by_parts([text.decode().split(" ") for text in texts])
        del there
        # The words that open a text first, then those with a space before them.
        order = np.argsort(~head[shown], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        which, shown = place[which], shown[order]
        lows, highs = starts[shown] + 1, (starts + sizes)[shown]
        text = whole.decode()
        if len(text) < len(raw):
            # Characters before a byte.
            before = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
            lows, highs = before[lows], before[highs]
        words = [text[low:high] for low, high in zip(lows.tolist(), highs.tolist())]
        opening = int(head[shown].sum())
        values = []
        for cache, lead, own in ((self._first, "", words[:opening]), (self._spaced, " ", words[opening:])):
            known = list(map(cache.get, own))
            gaps = [i for i, ids in enumerate(known) if ids is None]
            fresh = [own[i] for i in gaps]
            self._fill(cache, [fresh], lead)
            for i, word in zip(gaps, fresh):
                known[i] = cache[word]
            values += known
        flat = np.frombuffer(b"".join(values), "<u4")
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // 4
        begins = np.cumsum(lengths) - lengths
        sent = lengths[which]
        ends = np.cumsum(sent)
        ids = flat[np.arange(int(ends[-1])) + np.repeat(begins[which] - (ends - sent), sent)].tobytes()
        bounds = np.append(0, ends[firsts + counts - 1]) * 4
        return [ids[start:end] for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
