"""From raw documents to packed training sequences, one stage after another.

Every stage but the last returns the columns of ``documents``; each works on the rows its predecessor
kept.  A document that is rejected, a further copy of one that stays, and one with a passage of the
benchmark are dropped; personal data is replaced; what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import decontaminate, forest, packing, quality, surrogates
from riskframe.llm.common import table
from riskframe.llm.queries import KEY
from riskframe.session import materialised


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("predicted = 1").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates on five-word shingles, that of least identifier.

    Every row is a document of its own, whatever its identifier; rows without one come last.
    """
    keyed = materialised(docs.withColumn("__key", F.monotonically_increasing_id()))
    found = forest.near_duplicates(keyed, id_col="__key", width=5).select("__key", "component_id")
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "__key")
    placed = found.join(keyed.select("__key", at.alias("at")), "__key")
    first = placed.groupBy("component_id").agg(F.min("at").alias("at")).select(F.col("at.__key").alias("__key"))
    return keyed.join(first, "__key", "left_semi").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data, and their number of characters counted again."""
    return surrogates.replaced(docs, KEY).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their ids."""
    # Workers keep their caches for other stages, so this one is small.
    return packing.pack(docs, window=2048, end_id=1, cache_words=250_000)


STAGES = [
    ("quality classifier", accepted),
    ("near-dedup", distinct),
    ("decontamination", decontaminated),
    ("surrogates", private),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenising, hashing and learning have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
