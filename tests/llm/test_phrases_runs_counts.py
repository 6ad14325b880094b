import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from riskframe.llm import collocations, periodic, queries, tokencounts
from tests.conftest import SF

MID = "/root/testdata/sf0.01"


# --- token counts ----------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokencounts.default_path())


ODD = [
    "a", "B", "the", "'s", "'RE", "'", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "é", "Σ", "ς", "İ", "ß",
    "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "1", "²", "٣", "中文", "🙂", "́", "‍", "\x00", "\x7f",
    "...", "|", "ﬁ", "가", "가",
]


def test_op13_equals_the_library_on_odd_texts(library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(5_000)]
    texts += ["", "ab" * 50_000, "x" * 3_000 + " y", " ".join(["word"] * 20_000)]
    found = tokencounts.MergeCounter(tokencounts.default_path()).count([t.encode() for t in texts])
    assert found == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_op13_equals_the_library_on_documents(spark, library):
    texts = dict(duckdb.sql(f"select doc_id, text from '{MID}/documents.parquet'").fetchall())
    rows = queries.op13_token_counts(spark, MID).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), n, n > 2048)


def test_op13_a_small_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokencounts, "CACHE_PARTS", 20)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdé.", k=rng.randint(1, 90))) for _ in range(30)) for _ in range(50)]
    found = tokencounts.MergeCounter(tokencounts.default_path()).count([t.encode() for t in texts])
    assert found == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_op13_defined_results(spark):
    schema = "doc_id long, text string, n_tokens string, n_bytes int, __text int, parts int"
    rows = [(1, None, "x", 1, 2, 3), (1, "Hello, world", "y", 1, 2, 3), (None, "Hello, world", None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    found = tokencounts.token_counts(docs, limit=2, keep=["parts"]).collect()
    assert sorted((tuple(r) for r in found), key=repr) == [
        (1, 3, 0, 0, False),
        (1, 3, 12, 3, True),
        (None, None, 12, 3, True),
    ]
    assert tokencounts.token_counts(docs.filter("false")).collect() == []


# --- periodic runs ---------------------------------------------------------


def runs_of(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = set()
    for s, length, q in runs:
        gone.update(range(s + q, s + length))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def invented(rng, n):
    words, k = [], rng.randint(0, 5)
    while len(words) < n:
        most = k if rng.random() < 0.5 else 50
        unit = [str(rng.randint(0, most)) for _ in range(rng.randint(1, max(2, n // 4)))]
        words += (unit * rng.randint(1, 4))[: rng.randint(1, 4 * len(unit))]
        if rng.random() < 0.2:
            words.append(str(rng.randint(0, 99)))
    return words[:n]


@pytest.mark.parametrize("longest, rounds", [(40, 150), (160, 80), (900, 12)])
@pytest.mark.parametrize("labels", [1 << 16, 3])
def test_op12_equals_brute_force(longest, rounds, labels, monkeypatch):
    monkeypatch.setattr(periodic, "LABELS", labels)
    rng = random.Random(longest)
    for _ in range(rounds):
        texts = [invented(rng, rng.randint(0, longest)) for _ in range(rng.randint(1, 5))]
        found, left = periodic._found([" ".join(t).encode() for t in texts], 12)
        for words, own, rest in zip(texts, found, left):
            assert own == runs_of(words)
            assert rest.decode() == collapsed(words, own)


def test_op12_transforms_are_exact():
    rng = np.random.default_rng(4)
    for size in (32, 128, 512):
        blocks = rng.integers(0, 3, (6, size))
        windows = rng.integers(0, 3, (6, 3 * size - 1))
        for row, at in enumerate((0, 1, size, 2 * size - 1)):
            windows[row, at : at + size] = blocks[row]
        windows[4, 7 : 7 + size] = blocks[4]
        windows[4, 7 + size // 2] += 1
        expected = {
            (r, at)
            for r in range(6)
            for at in range(2 * size)
            if (windows[r, at : at + size] == blocks[r]).all()
        }
        assert set(zip(*(x.tolist() for x in periodic.matches(blocks, windows)))) == expected
        assert {(0, 0), (1, 1), (2, size), (3, 2 * size - 1)} <= expected
    x, y = rng.integers(0, 1 << 16, (2, 3, 64)).astype(np.uint64)
    for p, root in periodic.PRIMES:
        product = periodic.convolved(x, y, p, root)
        for r in range(3):
            plain = [sum(int(x[r, i]) * int(y[r, (k - i) % 64]) for i in range(64)) % p for k in range(64)]
            assert product[r].tolist() == plain


@pytest.mark.parametrize("n", [20_000, 60_000])
def test_op12_long_texts_of_one_word_and_long_periods(n):
    rng = random.Random(n)
    unit = [str(rng.randint(0, 10**6)) for _ in range(n // 3)]
    texts = [["a"] * n, unit * 3, (["a"] * 50 + ["b"]) * (n // 51)]
    found, _ = periodic._found([" ".join(t).encode() for t in texts], 12)
    assert found[0] == [(0, n, 1)]
    assert found[1] == [(0, 3 * len(unit), len(unit))]
    assert (0, n // 51 * 51, 51) in found[2] and len(found[2]) == 1 + n // 51


def test_op12_query_equals_brute_force(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    rows = queries.op12_periodic_runs(spark, SF).collect()
    assert len(rows) == len(texts)
    periodic_ones = 0
    for row in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[row["doc_id"]] or "")
        n, h = len(words), zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = runs_of(words)
        periodic_ones += bool(runs)
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        expected = (None,) * 4 if best is None else (best[1], -best[0], best[2], -best[0] * 1000 // best[2])
        assert tuple(row[c] for c in ("start", "length", "period", "exponent_milli")) == expected
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert row["n_runs"] == len(runs)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert periodic_ones > 10


def test_op12_defined_results(spark):
    schema = "doc_id long, text string, runs string, collapsed int, __text int, words int"
    tail = "x " + "a b " * 10
    rows = [(1, None, "r", 1, 2, 3), (1, "", "r", 1, 2, 3), (2, tail, "r", 1, 2, 3), (None, tail, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    found = periodic.periodic_runs(docs, keep=["words"]).collect()
    assert sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in found), key=repr) == [
        (1, 3, [], ""),
        (1, 3, [], ""),
        (2, 3, [(1, 20, 2)], "x a b"),
        (None, None, [(1, 20, 2)], "x a b"),
    ]
    assert periodic.periodic_runs(docs.filter("false")).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, least=4)


# --- collocations ----------------------------------------------------------


def phrases_of(rows, least, depth, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, depth + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        covered = set()
        for phrase, a in own.items():
            if a >= least and len(phrase) > 2:
                covered.update(p for p in (phrase[1:], phrase[:-1]) if own[p] == a)
        scored = []
        for phrase, a in own.items():
            if a < least or len(phrase) < 2 or phrase in covered:
                continue
            cuts = [(1000 * a * n[lang] // (own[phrase[:k]] * own[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            text = " ".join(phrase)
            scored.append((-score, -a, text.encode(), text, own[phrase[:k]], own[phrase[k:]]))
        for rank, (score, a, _, text, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, text, -a, left, right, n[lang], -score))
    return sorted(out)


def made(rng, count):
    rows = []
    for _ in range(count):
        words = [rng.choice(["a", "B", "c", "é", "dd", "e f", "ab cd ef gh", "x\ty"]) for _ in range(rng.randint(0, 30))]
        text = "".join(w + rng.choice([" ", " ", " ", ". ", "\n", "!", "  "]) for w in words)
        rows.append((rng.choice(["en", "fr", None, "und"]), rng.choice([text, text, None])))
    return rows


@pytest.mark.parametrize("shard_words, depth, least, top", [(40, 5, 4, 50), (1 << 20, 5, 4, 5), (40, 2, 3, 50), (7, 3, 6, 50)])
def test_op11_equals_brute_force(spark, shard_words, depth, least, top):
    rows = made(random.Random(shard_words + depth), 120)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    found = collocations.collocations(
        docs.repartition(3), least=least, depth=depth, top=top, shard_words=shard_words
    ).collect()
    expected = phrases_of(rows, least, depth, top)
    assert sorted(tuple(r) for r in found) == expected and len(expected) > 5


@pytest.mark.parametrize("sides", ["lll", "rrr", "lrl", "rlr"])
def test_op11_index_counts_every_phrase_on_either_side(sides):
    rng = random.Random(8)
    text = collocations._between_breaks(np.array([rng.randint(0, 4) for _ in range(400)]))
    index = collocations.BiIndex(text, 4)
    found = index.words()
    for size in range(1, 5):
        counts = Counter()
        for i in range(len(text) - size):
            phrase = tuple(text[i : i + size].tolist())
            if 0 not in phrase:
                counts[phrase] += 1
        phrases, _, _, n = found
        assert len(phrases) == len(counts)
        assert dict(zip(map(tuple, phrases.tolist()), n.tolist())) == counts
        if size < 4:
            found = index.extended(found, "left" if sides[size - 1] == "l" else "right")


def test_op11_long_texts_are_cut_between_pieces(spark, monkeypatch):
    text = "one two three. four five " * 40
    docs = spark.createDataFrame([(text, None)], "text string, lang string")
    expected = phrases_of([(None, text)], 5, 5, 50)
    monkeypatch.setattr(collocations, "STEP", 50)
    assert [tuple(r) for r in collocations.collocations(docs, least=5).collect()] == expected


def test_op11_defined_results(spark):
    schema = "doc_id long, text string, lang string, n int, words int, shard int, id int, word string, phrase string"
    rows = [(1, "a b a b", None, *[1] * 4, "w", "p")] * 3 + [(2, None, "en", *[1] * 4, "w", "p")]
    docs = spark.createDataFrame(rows, schema)
    found = [tuple(r) for r in collocations.collocations(docs, least=3).collect()]
    assert found == phrases_of([(r[2], r[1]) for r in rows], 3, 5, 2000)
    assert collocations.collocations(docs.filter("false")).collect() == []
    assert collocations.collocations(docs.filter("doc_id = 2")).collect() == []


def test_op11_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{MID}/documents.parquet'")
    rows = queries.op11_collocations(spark, MID)
    expected = con.sql(queries.ORACLE_SQL["op11_collocations"])
    assert rows.columns == expected.columns
    assert sorted(tuple(r) for r in rows.collect()) == sorted(expected.fetchall())
