"""Replication, oversampling and key-stable splits: no randomness, and no shuffle but for stratified folds.

A slot depends on the key's hash, so a recomputed or repartitioned table gives
the same split, and all copies of a row stay on one side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.columns import as_column, hash_slot
from riskframe.session import materialised
from riskframe.sources.schema import FOLDS, LABEL, OVERSAMPLING, TRAIN_PCT

HASHES = 1 << 31
#: Keys with more than such a part of a shuffle partition's rows are hot.
HOT_SHARE = 8


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def oversample(
    df: DataFrame, label: str = LABEL, factor: int = OVERSAMPLING, copy: str = "copy"
) -> DataFrame:
    """Keep negatives once and positives ``factor`` times, in a single scan."""
    if factor < 1:
        raise ValueError("factor must be at least 1")
    copies = F.when(F.col(label) == 1, F.sequence(F.lit(1), F.lit(factor)))
    return df.withColumn(copy, F.explode(copies.otherwise(F.array(F.lit(1)))))


def replicate(df: DataFrame, times: int, copy: str = "copy") -> DataFrame:
    """Every row ``times`` times, in a single scan."""
    if times < 1:
        raise ValueError("times must be at least 1")
    return df.withColumn(copy, F.explode(F.sequence(F.lit(1), F.lit(times))))


def hash_split(
    df: DataFrame,
    key: str | Sequence[str],
    train_pct: int = TRAIN_PCT,
    salt: str = "",
    method: str = "md5",
    out: str = "is_train",
) -> DataFrame:
    """Mark about ``train_pct`` percent of the keys as training keys."""
    return df.withColumn(out, hash_slot(_keys(key), 100, salt, method) < train_pct)


def train_test(
    df: DataFrame, key: str | Sequence[str], train_pct: int = TRAIN_PCT, salt: str = "", method: str = "md5"
) -> tuple[DataFrame, DataFrame]:
    """The two sides of :func:`hash_split` as separate tables."""
    inside = hash_slot(_keys(key), 100, salt, method) < train_pct
    return df.filter(inside), df.filter(~inside)


def hash_folds(
    df: DataFrame,
    key: str | Sequence[str],
    k: int = FOLDS,
    salt: str = "fold:",
    method: str = "md5",
    out: str = "fold",
) -> DataFrame:
    """Assign every key to one of ``k`` folds, independently of the split."""
    return df.withColumn(out, hash_slot(_keys(key), k, salt, method))


def _hash(key: str | Column, salt: str) -> Column:
    """The first 64 bits of the md5 of a salted key, whose upper half :func:`hash_slot` takes its slot from."""
    head = F.substring(F.md5(F.concat(F.lit(salt), as_column(key)).cast("binary")), 1, 16)
    return F.conv(head, 16, -10).cast("bigint")


def _counted(rows: DataFrame, parts: int) -> DataFrame:
    """``(__label, __key, __hash, __n)``, a key once or a few times: ``__n`` adds up to its rows.

    Keys are mostly few rows each, and counting them takes a shuffle of its own, so they pass as they
    are.  Only the keys of crowded slots, with more than one in ``parts`` rows, are counted map-side.
    """
    slot = F.pmod(F.xxhash64("__label", "__key"), F.lit(parts * HOT_SHARE)).cast("int")
    sizes = materialised(rows.groupBy(slot.alias("__slot")).agg(F.count(F.lit(1)).alias("__n")))
    crowded = F.col("__n") * parts > sizes.agg(F.sum("__n")).scalar()
    # Fewer than `parts` numbers.
    slots = [r["__slot"] for r in sizes.filter(crowded).collect()]
    if not slots:
        return rows.withColumn("__n", F.lit(1).cast("bigint"))
    some = rows.filter(slot.isin(slots)).groupBy("__label", "__key", "__hash").agg(F.count(F.lit(1)).alias("__n"))
    return rows.filter(~slot.isin(slots)).withColumn("__n", F.lit(1).cast("bigint")).unionByName(some)


def _key_folds(rows: DataFrame, k: int, salt: str) -> DataFrame:
    """``(__label, __hash, __name, __n, __fold)`` of the distinct keys of ``rows (__label, __key)``.

    The keys of a class are dealt in the order of their hashes.  They are ranked inside ranges of
    hashes, ``HOT_SHARE`` per shuffle partition, and a range starts where the ones below it end.
    ``__name`` is the key where another one of the class has the same hash, else null.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * HOT_SHARE
    place = F.shiftrightunsigned("__hash", 32).bitwiseAND(F.lit(HASHES - 1))  # hash_slot(["__key"], HASHES, salt)
    keys = _counted(rows.withColumn("__hash", _hash("__key", salt)), ranges)
    keys = keys.withColumn("__range", F.floor(place * ranges / HASHES).cast("int")).repartition("__range")
    keys = keys.groupBy("__label", "__range", "__hash", "__key").agg(F.sum("__n").alias("__n"))
    inside = Window.partitionBy("__label", "__range").orderBy(place, "__key")
    alike = Window.partitionBy("__label", "__range", "__hash")
    name = F.when(F.count(F.lit(1)).over(alike) > 1, F.col("__key"))
    ranked = keys.withColumn("__name", name).withColumn("__rank", F.pmod(F.row_number().over(inside) - 1, F.lit(k)))
    ranked = materialised(ranked.select("__label", "__range", "__hash", "__name", "__n", "__rank"))
    below = Window.partitionBy("__of").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    # One row per class and range.
    starts = materialised(
        ranked.groupBy(F.col("__label").alias("__of"), F.col("__range").alias("__at"))
        .agg(F.count(F.lit(1)).alias("__size"))
        .select("__of", "__at", F.coalesce(F.sum("__size").over(below), F.lit(0)).alias("__start"))
    )
    same = F.col("__of").eqNullSafe(F.col("__label")) & (F.col("__at") == F.col("__range"))
    fold = F.pmod(F.col("__start") + F.col("__rank"), F.lit(k)).cast("int")
    return ranked.join(starts, same).select("__label", "__hash", "__name", "__n", fold.alias("__fold"))


def stratified_folds(
    df: DataFrame,
    key: str | Sequence[str],
    k: int = FOLDS,
    label: str = LABEL,
    salt: str = "fold:",
    out: str = "fold",
) -> DataFrame:
    """Folds with as many keys of every class as can be: at most one more or less.

    Rows that share key and class share a fold; a null key is an empty one.  Distinct keys are ranked,
    not rows.  The folds go back to the rows by a join on the keys' hashes, and on the keys themselves
    where hashes are equal.  A key with more rows than the ``HOT_SHARE``-th part of a shuffle
    partition's share is hot; there are at most ``HOT_SHARE`` times as many as partitions, so they are
    broadcast, and their rows go to the join under numbers of their own that spread evenly.
    """
    keys = _keys(key)
    names = F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys])
    folds = _key_folds(df.select(F.col(label).alias("__label"), names.alias("__key")), k, salt)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * HOT_SHARE
    hot = F.col("__n") * parts > folds.agg(F.sum("__n")).scalar()
    rows = df.withColumn("__at", _hash(names, salt))

    def found(some: DataFrame, other: DataFrame, fold: str) -> DataFrame:
        side = other.select(F.col("__label").alias("__of"), F.col("__hash"), "__name", F.col("__fold").alias(fold))
        same = F.col("__of").eqNullSafe(F.col(label)) & (F.col("__hash") == F.col("__at"))
        return some.join(side, same & (F.col("__name").isNull() | (F.col("__name") == names)), "left").drop(
            "__of", "__hash", "__name"
        )

    marked = found(rows, F.broadcast(folds.filter(hot)), "__hot")
    spread = F.xxhash64(F.monotonically_increasing_id())
    marked = marked.withColumn("__at", F.when(F.col("__hot").isNull(), F.col("__at")).otherwise(spread))
    dealt = found(marked, folds.filter(~hot), "__cold")
    kept = [F.col(c) for c in df.columns if c != out]
    return dealt.select(*kept, F.coalesce("__hot", "__cold").alias(out))
