import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskframe.llm import packing, tokenfiles, tokens
from riskframe.llm.queries import op1_packing, op6_token_files
from riskframe.llm.tokens import Encoder, default_path, encoder
from riskframe.session import shared_path
from tests.conftest import SF


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_encoder_equals_the_tokenizer_on_any_white_space(plain):
    rng = random.Random(1)
    marks = ["a", "B", " ", "  ", "\n", "\t", "é", "1", ".", "'s", " ", " ", "\x1c", "中", "<|endoftext|>"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 30))) for _ in range(3000)] + ["", " ", "\n", " a", "a \n b"]
    texts += ["<|endoftext|>", "text <|endoftext|> more", "<|endoftext|><|endoftext|> x."]
    for text, ids in zip(texts, encoder(default_path()).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain(text), repr(text)


def test_long_texts_of_wide_characters_equal_the_tokenizer(plain):
    rng = random.Random(4)
    words = ["".join(rng.choices("abé中😀\n.,1", k=rng.randint(0, 6))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=k)) for k in (200_000, 1, 20, 50_000)]
    for text, ids in zip(texts, encoder(default_path()).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain(text)


def test_punctuation_after_a_known_word_needs_no_encoding_of_the_word(plain, monkeypatch):
    own, tails = Encoder(default_path()), ["$$$", "!", ".***", "'", "%'&", ",,", ")\"", "<|", "_"]
    texts = [f"Haus zz{tail} zz été{tail}" for tail in tails]
    own.encode(["Haus zz été zz été Haus"])
    encoded, whole = [], own._whole
    monkeypatch.setattr(own, "_whole", lambda text: encoded.append(text) or whole(text))
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain(text), repr(text)
    assert sorted(encoded) == sorted(tails)


def test_powers_for_a_long_text_are_not_kept():
    n = 2 * tokens.TOGETHER + 1
    powers = tokens._powers(tokens._BASE, n)
    assert len(powers) >= n and len(tokens._powers(tokens._BASE, 10)) == 2 * tokens.TOGETHER
    undone = powers[:10] * tokens._powers(tokens._UNBASE, 10)[:10]
    assert (undone == 1).all()


def test_a_small_cache_changes_nothing(plain):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdé.,", k=rng.randint(1, 5))) for _ in range(400)]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\n\n", "  ", "\t"]) for _ in range(60)) for _ in range(200)]
    small = Encoder(default_path())
    small.cache_words = 50
    for i in range(0, 200, 20):
        for text, ids in zip(texts[i : i + 20], small.encode(texts[i : i + 20])):
            assert np.frombuffer(ids, "<u4").tolist() == plain(text), repr(text)


def whole(rows, texts, plain, end, window):
    """Every id lies in one piece and every sequence is gapless; returns the padding."""
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    assert set(docs) == set(texts)
    for doc, pieces in docs.items():
        ids, at = [*plain(texts[doc]), end], 0
        for p in sorted(pieces, key=lambda r: r["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == crc(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for pieces in bins.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_op1_covers_every_id_once(spark, plain):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert whole(op1_packing(spark, SF).collect(), texts, plain, 1, 2048) == 0


def test_packing_edge_cases(spark, documents, plain):
    texts = [None, "", "a <|endoftext|> c", "a b c", "word " * 900, "x" * 4000, "\n\n  \t", "a b c d e f g " * 3]
    docs = documents(texts)
    clash = docs.withColumns({"start": F.lit(7), "ids": F.lit("x"), "sequence_id": F.lit(None), "doc": F.lit(1)})
    for source in (docs, clash):
        rows = packing.pack(source, window=64).collect()
        assert whole(rows, dict(enumerate(texts)), plain, 1, 64) == 0
        assert all(len(r["ids"]) == r["length"] for r in rows)
    assert packing.pack(docs.limit(0)).count() == 0
    few = packing.pack(documents(["a b c d e"] * 500).coalesce(1), window=16, max_open=3, keep_ids=False)
    assert whole(few.collect(), dict(enumerate(["a b c d e"] * 500)), plain, 1, 16) == 0


def test_placement_keeps_the_sum_of_squares_least():
    rng = random.Random(3)
    levels = packing.Levels(16)
    for _ in range(400):
        size = rng.randint(1, 16)
        before = levels.count.copy()

        def after(level):
            n = before.copy()
            if level:
                n[level] -= 1
            if level + size < 16:
                n[level + size] += 1
            return int((n**2).sum())

        best = min(after(h) for h in range(17 - size) if h == 0 or before[h])
        levels.place(packing.Piece(0, b"\0" * 4 * size, 0, size))
        assert int((levels.count**2).sum()) == best
        assert [len(b) for b in levels.bins] == levels.count.tolist()


def test_op6_equals_plain_encoding(spark, plain):
    rows = sorted(op6_token_files(spark, SF).collect(), key=lambda r: r["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert [r["doc_id"] for r in rows] == sorted(texts)
    at = 0
    for r in rows:
        ids = [*plain(texts[r["doc_id"]]), 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip_and_prune(spark, documents, plain, encoding):
    texts = [None, "", "a <|endoftext|>b", "a b", "x " * 5000, "ß é"] + [f"w{i}" for i in range(200)]
    docs = documents(texts, first=10).withColumn("ids", F.lit(1)).withColumn("file", F.lit("x"))
    docs = docs.unionByName(docs.filter("doc_id = 12"))
    path = shared_path(spark, "tokens")
    tokenfiles.write_tokens(docs, path, end_id=0, encoding=encoding)
    rows = tokenfiles.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted([*range(10, 10 + len(texts)), 12])
    at = 0
    for r in rows:
        assert r["ids"] == [*plain(texts[r["doc_id"] - 10]), 0] and r["start"] == at
        at += r["n_tokens"]
    some = tokenfiles.read_tokens(spark, path, 20, 24)
    assert sorted(r["doc_id"] for r in some.collect()) == [20, 21, 22, 23, 24]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,20)" in plan
    meta = tokenfiles.read_metadata(spark, path)
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    assert meta.count() == len(rows)
    import pyarrow.parquet as pq

    files = [f.removeprefix("file://") for f in spark.read.parquet(path).inputFiles()]
    column = pq.ParquetFile(files[0]).metadata.row_group(0).column(4)
    assert column.path_in_schema == "ids.list.element" and column.has_column_index
    assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")


def test_token_files_of_an_empty_table(spark, documents):
    path = shared_path(spark, "tokens")
    tokenfiles.write_tokens(documents([]), path)
    assert tokenfiles.checksums(tokenfiles.read_tokens(spark, path)).count() == 0
