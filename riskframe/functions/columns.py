"""Column expressions; all are JVM built-ins that stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bucket(col: str | Column, bounds: Sequence[float], labels: Sequence | None = None) -> Column:
    """Label of the half-open interval ``[bounds[i-1], bounds[i])`` holding ``col``.

    Without labels the interval's index is returned: how many bounds are ``<=
    col``.  Null stays null.
    """
    if list(bounds) != sorted(set(bounds)):
        raise ValueError("bounds must be strictly increasing")
    names = list(range(len(bounds) + 1)) if labels is None else list(labels)
    if len(names) != len(bounds) + 1:
        raise ValueError("need one label more than bounds")
    value = as_column(col)
    expr = F.when(value.isNull(), F.lit(None))
    for bound, name in zip(bounds, names):
        expr = expr.when(value < F.lit(float(bound)), F.lit(name))
    return expr.otherwise(F.lit(names[-1]))


def time_bucket(col: str | Column, width: float = 3600) -> Column:
    """Number of the ``width``-second window that ``col`` falls into."""
    return F.floor(as_column(col) / F.lit(width)).cast("int")


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    """``part`` of ``whole`` in percent; null when ``whole`` is zero."""
    rate = F.try_divide(part, whole) * 100
    return rate if digits is None else F.round(rate, digits)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def hash_slot(
    keys: Sequence[str | Column], slots: int, salt: str = "", method: str = "md5"
) -> Column:
    """A slot in ``[0, slots)`` that depends on the key alone.

    ``md5`` can be reproduced by any engine; ``xxhash64`` costs about half.
    A null key counts as an empty string, so its rows get a slot as well.
    """
    parts = [F.coalesce(as_column(k).cast("string"), F.lit("")) for k in keys]
    text = F.concat_ws("-", *parts) if len(parts) > 1 else parts[0]
    text = F.concat(F.lit(salt), text) if salt else text
    if method == "md5":
        head = F.substring(F.md5(text.cast("binary")), 1, 8)
        return (F.conv(head, 16, 10).cast("bigint") % slots).cast("int")
    if method == "xxhash64":
        return F.pmod(F.xxhash64(text), F.lit(slots)).cast("int")
    raise ValueError(f"unknown method {method!r}; use 'md5' or 'xxhash64'")


def positive_probability(col: str | Column = "probability") -> Column:
    """Second element of a binary classifier's probability vector."""
    return vector_to_array(as_column(col))[1]
