"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import (
    collocations,
    decontaminate,
    forest,
    neighbours,
    packing,
    periodic,
    preferences,
    quality,
    shards,
    surrogates,
    tokencounts,
    tokenfiles,
    urls,
)
from riskframe.llm.common import table
from riskframe.session import shared_path

#: The key of the registered queries; a caller passes one of their own and keeps it secret.
KEY = "surrogates"

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, window=2048, end_id=1, keep_ids=False, cache_words=1_600_000)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.kd_shards(table(spark, sf_dir, "documents"), shards=24)
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _spans(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.preference_pairs(*preferences.stale_replies(table(spark, sf_dir, "conversations")))
    return pairs.select(
        "pair_id",
        "n_prefix",
        "prompt",
        "chosen",
        "rejected",
        _spans("chosen_spans").alias("chosen_mask"),
        _spans("rejected_spans").alias("rejected_mask"),
        "paired",
    )


def held_out(doc_id: str | Column) -> Column:
    """The rows that no quality model may learn from."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3
    return F.coalesce(remainder == 1, F.lit(False))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    scored = quality.score(docs, quality.fit(docs, known), keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), path, end_id=0)
    return tokenfiles.checksums(tokenfiles.read_tokens(spark, path))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surrogates.checked(surrogates.entities(table(spark, sf_dir, "documents"), KEY))
    return found.select(
        "doc_id",
        "ordinal",
        "kind",
        "start",
        F.length("entity").alias("length"),
        F.crc32(F.col("entity").cast("binary")).alias("entity_crc32"),
        "surrogate",
        "collides",
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.scan(docs, items, window=10, keep=["doc_id"]))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Make a tenth of the documents periodic from some word on: their crc32 says which, where and how."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    turn = F.floor(hashed / 10)
    words = docs.select("doc_id", "text", hashed.alias("hash"), turn.alias("turn")).withColumn(
        "words",
        F.when(hashed % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))),
    )
    n = F.size("words")
    words = words.withColumn("first", F.when(n > 0, (F.col("turn") % n).cast("int")))
    words = words.withColumn("period", (1 + F.floor((n - F.col("first")) / (3 + F.col("turn") % 8))).cast("int"))
    again = F.expr("transform(words, (w, i) -> if(i < first, w, words[first + (i - first) % period]))")
    return words.select(
        "doc_id", F.when(F.col("first").isNotNull(), F.concat_ws(" ", again)).otherwise(F.col("text")).alias("text")
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    ranked = F.array_sort(
        F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"].alias("n")))
    )
    longest = F.try_element_at(ranked, F.lit(1))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        F.col("longest.n").alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("1000 * longest.n div longest.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(table(spark, sf_dir, "documents"), limit=2048)


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_neighbours": op2_neighbours,
    "op3_kd_shards": op3_kd_shards,
    "op4_preferences": op4_preferences,
    "op5_quality": op5_quality,
    "op6_token_files": op6_token_files,
    "op7_surrogates": op7_surrogates,
    "op8_decontamination": op8_decontamination,
    "op9_urls": op9_urls,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_counts": op13_token_counts,
}

_TURNS = r"""
WITH marked AS (
  SELECT conv_id, turn, role, text,
    max(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS last_turn,
    last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER earlier AS reply,
    lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM conversations
  WINDOW earlier AS (PARTITION BY conv_id ORDER BY turn, role, text
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role,
    last_turn IS NOT NULL AS paired, text AS c,
    CASE WHEN role = 'assistant' AND turn = last_turn THEN coalesce(reply, before, '') ELSE text END AS r
  FROM marked WHERE last_turn IS NULL OR turn <= last_turn),
prefix AS (
  SELECT conv_id, bool_and(paired) AS paired,
    CASE WHEN NOT bool_and(paired) THEN 0
      ELSE coalesce(min(CASE WHEN c <> r THEN i END) - 1, count(*)) END AS n
  FROM turns GROUP BY conv_id),
lines AS (
  SELECT conv_id, i, n, p.paired, role,
    '<|' || role || E'|>\n' || c || E'<|end|>\n' AS c, '<|' || role || E'|>\n' || r || E'<|end|>\n' AS r,
    length(role) + 5 AS head
  FROM turns t JOIN prefix p USING (conv_id)),
placed AS (
  SELECT *, sum(length(c)) OVER w AS c_end, sum(length(r)) OVER w AS r_end
  FROM lines WINDOW w AS (PARTITION BY conv_id, i > n ORDER BY i))
SELECT conv_id AS pair_id, CAST(n AS INTEGER) AS n_prefix,
  coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE i <= n), '') AS prompt,
  coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE i > n), '') AS chosen,
  coalesce(string_agg(r, '' ORDER BY i) FILTER (WHERE i > n AND paired), '') AS rejected,
  coalesce(string_agg((c_end - length(c) + head) || '-' || c_end, ',' ORDER BY i)
    FILTER (WHERE i > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((r_end - length(r) + head) || '-' || r_end, ',' ORDER BY i)
    FILTER (WHERE i > n AND role = 'assistant' AND paired), '') AS rejected_mask,
  paired
FROM placed GROUP BY conv_id, n, paired
"""



def _words(pattern: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{pattern}')"


_PASSAGES = r"""
WITH d AS (SELECT doc_id, @words@ AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, @words@ AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
placed AS (SELECT item, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM sized),
grams AS (SELECT DISTINCT item, n, array_to_string(w[s + 1 : s + n], ' ') AS g FROM placed),
sizes AS (SELECT DISTINCT n FROM grams),
starts AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
found AS (SELECT DISTINCT s.doc_id, s.n, s.i, item
  FROM (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g FROM starts) s JOIN grams USING (n, g)),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found),
hits AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""".replace("@words@", _words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))

_COMPONENTS = r"""
WITH RECURSIVE d AS (SELECT doc_id, @words@ AS w FROM documents),
long AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) >= 2),
sets AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS g FROM long
  UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN sizes USING (doc_id)
""".replace("@words@", _words(r"[^\x20\x09-\x0D]+"))

_PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, w[i : i + k - 1] AS g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
parts AS (
  SELECT lang, g[1 : k - 1] AS g, f FROM f WHERE k > 2
  UNION ALL SELECT lang, g[2 : k] AS g, f FROM f WHERE k > 2),
longer AS (SELECT lang, g, max(f) AS f FROM parts GROUP BY ALL),
cand AS (SELECT f.lang, f.k, f.g, f.f AS a FROM f LEFT JOIN longer o ON o.lang = f.lang AND o.g = f.g
  WHERE f.k >= 2 AND coalesce(o.f, 0) < f.f),
cuts AS (SELECT lang, g, a, g[1 : c] AS x, g[c + 1 : k] AS y, c FROM cand, range(1, 5) t(c) WHERE c < k),
scored AS (SELECT cuts.lang, cuts.g, a, c, l.f AS l, r.f AS r, n,
    CAST((1000 * a::HUGEINT * n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = x JOIN f r ON r.lang = cuts.lang AND r.g = y
  JOIN totals t ON t.lang = cuts.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op4_preferences": _TURNS,
    "op8_decontamination": _PASSAGES,
    "op10_near_duplicates": _COMPONENTS,
    "op11_collocations": _PHRASES,
}
