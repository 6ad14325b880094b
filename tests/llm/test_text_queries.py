import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.llm import decontaminate, preferences, quality, queries, shards, urls
from riskframe.session import materialised
from tests.conftest import SF

MID = "/root/testdata/sf0.01"


def pandas(name, sf=SF):
    return duckdb.sql(f"select * from '{sf}/{name}.parquet'").df()


# --- benchmark passages ----------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def hits(text, items, window=10):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        own = WORD.findall(lower(body))
        size = min(window, len(own))
        for s in range(len(own) - size + 1) if size else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[s : s + size]:
                    hit.update(range(i, i + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_op8_equals_brute_force(spark):
    items = [(r.item_id, r.text) for r in pandas("benchmark").itertuples()]
    owners, short = defaultdict(set), {}
    docs = {r.doc_id: r.text for r in pandas("documents").itertuples()}
    rows = {r["doc_id"]: r for r in queries.op8_decontamination(spark, SF).collect()}
    assert set(rows) == set(docs)
    for item, body in items:
        own = WORD.findall(lower(body))
        for s in range(max(1, len(own) - 9) if own else 0):
            owners[tuple(own[s : s + 10])].add(str(item))
    sizes = {len(k) for k in owners}
    for doc, text in docs.items():
        words = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if who := owners.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= who
        r = rows[doc]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (
            len(words), len(hit), len(found), sha, bool(hit),
        )
    assert any(r["contaminated"] for r in rows.values()) and not all(r["contaminated"] for r in rows.values())


@pytest.mark.parametrize("automaton_bytes", [1 << 20, 40])
def test_decontamination_edge_cases(spark, documents, automaton_bytes):
    items = [(1, "a B c d"), (2, "Zwölf; Boxkämpfer jagen"), (3, None), (4, " .,- "), (None, "q r"), (5, "d e"), (5, "e"), (10, "a b c d")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [None, "", "--", "x A, b. C\nd e", "a b c d a b c d", "zwölf\x85boxkämpfer jagen zwölf boxkämpfer JAGEN", "ZWÖLF Boxkämpfer jagen",
             "abc d", "x " * 3000 + "d e", "d e", "d e"]
    docs = documents(texts).withColumn("contamination", F.lit(1)).withColumn("n_hit", F.lit(2))
    found = decontaminate.scan(docs, bench, window=3, automaton_bytes=automaton_bytes)
    assert found.columns == [*(c for c in docs.columns if c != "contamination"), "contamination"]
    kept = [(i, t) for i, t in items if i is not None]
    rows = found.collect()
    assert len(rows) == len(texts)
    for r in rows:
        c = r["contamination"]
        assert (c["n_words"], c["n_hit"], c["items"]) == hits(r["text"], kept, 3)
        for s in c["spans"]:
            words = WORD.findall(lower(r["text"][s["start"] : s["end"]]))
            assert words == WORD.findall(lower(r["text"]))[s["first_word"] : s["last_word"] + 1]
    cleaned = decontaminate.clean(docs, bench, window=3, automaton_bytes=automaton_bytes)
    assert cleaned.columns == docs.columns
    assert sorted(r["doc_id"] for r in cleaned.collect()) == [0, 1, 2, 6, 7]
    assert decontaminate.scan(docs.limit(0), bench, automaton_bytes=automaton_bytes).count() == 0
    none = decontaminate.digest(decontaminate.scan(docs, bench.limit(0)))
    assert none.filter("contaminated or n_items > 0").count() == 0


# --- URLs ------------------------------------------------------------------


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(url):
    host, path = parts(url)
    fitting = [
        (f"{h}{p}", kind) for kind, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fitting, key=lambda r: len(r[0]), default=(None, None))


def test_op9_rules_and_verdicts(spark):
    rows = {r["page_id"]: r for r in queries.op9_urls(spark, SF).collect()}
    pages = pandas("pages")
    assert len(rows) == len(pages)
    for r in pages.itertuples():
        rule, kind = rule_of(r.url)
        got = rows[r.page_id]
        assert (got["host"], got["path"], got["rule"]) == (*parts(r.url), rule)
        assert got["verdict"] == kind if rule else got["verdict"] in ("allow", "block")


def test_url_edge_cases(spark):
    texts = [None, "", "x", "http://", "HTTP://A.NET", "a://B.net/x?y#z", "s://example.net/en/a", "s://q.example.net/en",
             "s://xexample.net/en/", "s://ORG/fr/?q", "s://a.org#/fr/", "s://ä.example.com/de/é\nü", "a://b://c.net/", "s://example.net/en/a"]
    rows = [(i, t, "old", 1) for i, t in enumerate(texts)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, score int")
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    for i, t in enumerate(texts):
        rule, kind = rule_of(t)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (*parts(t), rule), t
        assert got[i]["verdict"] == (kind or got[i]["verdict"])
    assert urls.judge(pages.limit(0)).count() == 0
    alone = urls.judge(pages.filter("page_id in (0, 2, 4)")).collect()
    assert {r["verdict"] for r in alone} == {"allow"}


def test_url_scores_equal_a_model_of_plain_dictionaries(spark):
    yes, no = [f"http://a{i}.org/fr/{i * 7}" for i in range(40)], [f"http://b.net/{i}?buy=cheap" for i in range(60)]
    frame = spark.createDataFrame([(u, True) for u in yes] + [(u, False) for u in no], "url string, ok boolean")
    model = urls.fit(frame, "url", "ok")
    held = {r["url"]: r["held"] for r in frame.withColumn("held", F.pmod(F.xxhash64("url"), F.lit(urls.FOLDS)) == 0).collect()}

    def counts(of):
        found = Counter()
        for u in of:
            if not held[u]:
                symbols = [*u.encode(), "end"]
                for i, s in enumerate(symbols):
                    for k in range(urls.ORDER + 1):
                        context = tuple(["^"] * (k - i) + symbols[max(0, i - k) : i])
                        found[k, context] += 1
                        found[k, context, s] += 1
        return found

    def log(u, found):
        total, symbols = 0.0, [*u.encode(), "end"]
        for i, s in enumerate(symbols):
            p = 1 / urls.SYMBOLS
            for k in range(urls.ORDER + 1):
                context = tuple(["^"] * (k - i) + symbols[max(0, i - k) : i])
                p = (found[k, context, s] + urls.STRENGTH * p) / (found[k, context] + urls.STRENGTH)
            total += math.log(p)
        return total / len(symbols)

    a, b = counts(yes), counts(no)
    for r in urls.score(frame, model, "url").collect():
        assert r["score"] == pytest.approx(log(r["url"], a) - log(r["url"], b), rel=1e-4, abs=1e-4)
        assert (r["score"] >= model.cut) == r["ok"]


def test_url_lookups_do_not_pass_through_the_driver(spark):
    # A chunk asks for many times the bytes that its URLs have, so a small table is no sign of a small answer.
    frame = spark.createDataFrame([(f"http://h{i % 2}.org/{i}", i % 2 == 0) for i in range(100)], "url string, ok boolean")
    scored = urls.score(frame, urls.fit(frame, "url", "ok"), "url")
    assert scored.count() == 100
    for plan in (scored, scored.groupBy("ok").count()):
        plan.collect()
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()


def test_url_models_keep_every_context(spark):
    # More than 2^20 contexts and symbols, nearly all of them seen once.
    rng = np.random.default_rng(4)
    paths = ["".join(p) for p in rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), (6_000, 60))]
    rows = [(f"http://h.org/{p}", i % 2 == 0) for i, p in enumerate(paths)]
    frame = materialised(spark.createDataFrame([*rows, (None, None), rows[0]], "url string, ok boolean"))
    model = urls.fit(frame, "url", "ok")
    counted = [(u, ok) for u, ok in [*rows, rows[0]] if ok is not None]
    held = {r["url"] for r in frame.filter(F.pmod(F.xxhash64("url"), F.lit(urls.FOLDS)) == 0).collect()}
    keys = {}
    for u, ok in counted:
        if u not in held:
            for pair in urls._places([u.encode()], urls.ORDER)[2]:
                for k in np.concatenate(pair).tolist():
                    keys.setdefault(k, [0, 0])[ok] += 1
    assert len(keys) > 1 << 20
    assert model.table.count() == len(keys)
    known = np.array(sorted(keys))
    counts = np.array([keys[k] for k in known.tolist()], float).T
    got = urls.score(frame, model, "url").collect()
    assert len(got) == len(frame.collect())
    texts = [r["url"] or "" for r in got]
    want = urls.scores([t.encode() for t in texts], known, counts)
    assert np.allclose([r["score"] for r in got], want, rtol=1e-9, atol=1e-12)
    # URLs that were counted are told apart by contexts seen once.
    assert np.mean([(r["score"] > 0) == r["ok"] for r in got if r["url"] and r["url"] not in held]) > 0.99


# --- quality ---------------------------------------------------------------


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    values, inverse, size = np.unique(np.asarray(scores)[order], return_inverse=True, return_counts=True)
    ranks[order] = (np.cumsum(size) - (size - 1) / 2)[inverse]
    labels = np.asarray(labels)
    p = labels.sum()
    return (ranks[labels == 1].sum() - p * (p + 1) / 2) / (p * (len(labels) - p))


def test_op5_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in queries.op5_quality(spark, MID).collect()}
    assert len(rows) == len(pandas("documents", MID))
    for r in rows.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    judged = [(rows[r.doc_id]["score"], r.quality) for r in pandas("labels", MID).itertuples() if rows[r.doc_id]["held_out"]]
    scores, marks = zip(*judged)
    assert auc(scores, marks) > 0.97
    assert np.mean((np.asarray(scores) >= 0.5) == np.asarray(marks)) > 0.95


def test_vectorised_ngrams_equal_plain_counts():
    texts = [b"", b"  ", "a A a a% ß12 \n\nX-y".encode(), b"a", b"one two one two two"]
    kinds = quality.ngrams(texts)
    for number, text in enumerate(texts):
        words = [w.lower() if w.isascii() else w for w in text.split()]
        own = [slot[doc == number] for doc, slot in kinds]
        n = len(words)
        assert [len(o) for o in own] == [n, max(n - 1, 0), n, max(n - 1, 0), max(n - 2, 0), max(n - 2, 0)]
        for i in range(n):
            for j in range(n):
                assert (own[0][i] == own[0][j]) == (words[i] == words[j])
    weights = np.random.default_rng(1).normal(size=1 << quality.BITS)
    found = quality.dots(texts, weights)
    for text, value in zip(texts, found):
        slots, values = quality.sparse(text)
        assert value == pytest.approx(float(weights[slots] @ values))


def test_a_repeated_identifier_is_learned_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = labels.filter("quality is not null").first()["doc_id"]
    again = docs.filter(F.col("doc_id") == first).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("copy")
    one, many = (quality.fit(d, labels, epochs=1) for d in (docs, docs.unionByName(again)))
    assert (one.weights == many.weights).all() and one.bias == many.bias


def test_quality_edge_cases(spark, documents):
    docs = documents([None, "", "good words here", "good words here", "bad!! BAD!!" * 50, "x" * 50_000])
    docs = docs.withColumn("score", F.lit("old")).unionByName(
        spark.createDataFrame([(None, "no id", "en", "s", 1, "old")], "doc_id long, text string, lang string, source string, n_chars long, score string")
    )
    labels = spark.createDataFrame([(2, 1), (3, 1), (4, 0), (4, 0), (5, None), (None, 0), (0, 7), (2, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model)
    assert out.columns == [*docs.columns[:-1], "score", "predicted"]
    got = out.collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[0] == by[1] == pytest.approx(1 / (1 + math.exp(-model.bias))) and by[2] == by[3] > by[4]
    bare = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, bare).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


# --- shards ----------------------------------------------------------------


def check_shards(rows, n, total, slack):
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < n
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / n) <= slack
    return by


def test_op3_shards_are_even(spark):
    docs = pandas("documents", MID)
    rows = queries.op3_kd_shards(spark, MID).collect()
    texts = dict(zip(docs.doc_id, docs.text))
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
    total = sum(r["size"] for r in rows)
    check_shards(rows, 24, total, 0.03 * total / 24 + max(r["size"] for r in rows) / 2)
    copies = defaultdict(set)
    for r in rows:
        copies[texts[r["doc_id"]]].add(r["shard"])
    assert sum(len(s) > 1 for s in copies.values()) <= 5


def test_shards_split_hot_texts_and_hold_edge_cases(spark, documents):
    texts = [None, "", ""] + ["same text"] * 400 + [f"text {i}" * (i % 9 + 1) for i in range(400)]
    docs = documents(texts).withColumn("shard", F.lit("x")).withColumn("size", F.lit(0))
    docs = docs.unionByName(docs.filter("doc_id < 5"))
    rows = shards.kd_shards(docs, shards=7).collect()
    assert len(rows) == len(texts) + 5
    total = sum(r["size"] for r in rows)
    check_shards(rows, 7, total, 0.05 * total / 7 + 100)
    assert shards.kd_shards(docs.limit(0), shards=5).count() == 0
    assert {r["shard"] for r in shards.kd_shards(docs.limit(2), shards=5).collect()} <= set(range(5))
    sized = shards.kd_shards(docs, target_bytes=total // 3 + 1).collect()
    assert {r["shard"] for r in sized} == {0, 1, 2}
    with pytest.raises(ValueError):
        shards.kd_shards(docs)


# --- preferences -----------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{MID}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    key = want.columns[0]
    got = queries.QUERIES[name](spark, MID).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = (f.sort_values(key)[list(want.columns)] for f in (got, want))
    assert json.loads(got.to_json(orient="values")) == json.loads(want.to_json(orient="values"))


def test_preference_edge_cases(spark):
    schema = "pair_id long, turn int, role string, text string, side string"
    chosen = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "yes"), (1, 2, "assistant", "yes"),
              (2, 0, None, None), (2, None, "user", "first"), (3, 0, "user", "same"), (4, 0, "user", "only"),
              (None, 0, "user", "lost"), (6, 0, "user", "x" * 100_000), (6, 1, "assistant", "é")]
    rejected = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "no"), (1, 3, "assistant", "more"),
                (2, 0, "user", ""), (3, 0, "user", "same"), (5, 0, "assistant", "r"), (6, 0, "user", "x" * 100_000)]
    sides = [spark.createDataFrame([(*r, "clash") for r in rows], schema) for rows in (chosen, rejected)]
    got = {r["pair_id"]: r for r in preferences.preference_pairs(*sides).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    one = got[1]
    assert one["n_prefix"] == 2 and one["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n"
    assert one["chosen"] == "<|assistant|>\nyes<|end|>\n"
    assert [one["chosen"][s["start"] : s["end"]] for s in one["chosen_spans"]] == ["yes<|end|>\n"]
    assert [one["rejected"][s["start"] : s["end"]] for s in one["rejected_spans"]] == ["no<|end|>\n", "more<|end|>\n"]
    assert got[2]["n_prefix"] == 0 and got[2]["chosen"].startswith("<|user|>\nfirst")
    assert (got[3]["n_prefix"], got[3]["chosen"], got[3]["rejected"], got[3]["paired"]) == (1, "", "", True)
    assert (got[4]["paired"], got[4]["rejected"], got[5]["chosen"], got[5]["paired"]) == (False, "", "", False)
    assert got[6]["n_prefix"] == 1 and got[6]["rejected"] == "" and got[6]["chosen_spans"][0]["start"] == 14
    assert preferences.preference_pairs(*[s.limit(0) for s in sides]).count() == 0
