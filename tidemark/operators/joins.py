"""Join helpers for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one part in this many of the rows, so there
#: are never more hot keys than this: lists of them may be collected and sent about.
HOT_PARTS = 64


def hot_keys(counts: DataFrame, key: str, total: int, parts: int = HOT_PARTS) -> list:
    """Keys of ``counts(key, n)`` with more than ``total / parts`` rows; at most ``parts``.

    The null key is never hot: it joins nothing.
    """
    hot = counts.where(F.col(key).isNotNull() & (F.col("n") > total / parts)).select(key)
    return [row[0] for row in hot.collect()]


def hot_values(df: DataFrame, key: str, parts: int = HOT_PARTS) -> list:
    """Hot keys of a table that is cheap to read twice (a kept one)."""
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return hot_keys(counts, "key", df.count(), parts)


def salted_join(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    hot: list,
    spread: Column,
    salts: int = 32,
    how: str = "inner",
) -> DataFrame:
    """Equi-join that spreads the rows of hot keys over ``salts`` tasks.

    ``hot`` are values of ``on[0]`` (see :func:`hot_keys`).  Fact rows of a hot key
    get a salt from the hash of ``spread``, its dimension rows are repeated once per
    salt; all other rows meet under salt 0 and are neither copied nor moved twice.
    """
    if not hot:
        return facts.join(dim, list(on), how)
    is_hot = F.col(on[0]).isin(hot)
    left = facts.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0))
    many = F.sequence(F.lit(0), F.lit(salts - 1))
    right = dim.withColumn("_salt", F.explode(F.when(is_hot, many).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
