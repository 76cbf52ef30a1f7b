"""Rates, agreement and share reports over graded runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``, 0 where there is nothing to divide by."""
    return F.coalesce(100 * F.try_divide(part, whole), F.lit(0.0))


def pass_rates(df: DataFrame, group: str, passed: str) -> DataFrame:
    """``(group, level, n, passed, pct)`` by group, plus one ``ALL`` row (level 1)."""
    return (
        df.rollup(group)
        .agg(F.grouping(group).cast("int").alias("level"), F.count("*").alias("n"), F.count_if(F.col(passed)).alias("passed"))
        .withColumn("pct", F.round(percent(F.col("passed"), F.col("n")), 4))
        .withColumn(group, F.when(F.col("level") == 1, "ALL").otherwise(F.col(group)))
    )


def check_matrix(df: DataFrame, group: str, checks: str) -> DataFrame:
    """``(group, name, n, failed)`` of an array of named checks; null and unnamed ones left out."""
    flat = df.select(group, F.explode(checks).alias("c")).where("c.name IS NOT NULL")
    return flat.groupBy(group, F.col("c.name").alias("name")).agg(F.count("*").alias("n"), F.count_if(~F.col("c.passed")).alias("failed"))


def agreement(df: DataFrame, by: Sequence[str], label: str, verdict: str, positive: str) -> DataFrame:
    """Agreement of a verdict with a label: counts, both directions of disagreement, missing
    verdicts, percentage, and Cohen's kappa (null where chance agreement is total).

    A missing verdict disagrees and takes no part in kappa; a missing label drops the row.
    """
    a, b = F.col(label), F.col(verdict)
    rows = df.where(a.isNotNull())
    both = b.isNotNull()
    n = F.count("*")
    m, agree = F.count_if(both), F.count_if(both & (a == b))
    p, q = F.count_if(both & (a == positive)), F.count_if(both & (b == positive))
    chance = (p * q + (m - p) * (m - q)) / (m * m)
    observed = F.try_divide(agree, m)
    found = rows.groupBy(*by).agg(
        n.alias("n"),
        agree.alias("agree"),
        F.count_if(both & (a == positive) & (b != positive)).alias("label_only"),
        F.count_if(both & (a != positive) & (b == positive)).alias("verdict_only"),
        F.count_if(~both).alias("unparsed"),
        F.round(percent(agree, n), 4).alias("pct"),
        F.when(m > 0, F.round(F.try_divide(observed - chance, F.nullif(1 - chance, F.lit(0.0))), 6)).alias("kappa"),
    )
    return found


def flips(before: DataFrame, after: DataFrame, key: str, good: str) -> DataFrame:
    """``(key, change)``: items ``fixed`` or ``broken`` between two runs; null counts as not good."""
    a = before.select(key, F.coalesce(F.col(good), F.lit(False)).alias("a"))
    b = after.select(key, F.coalesce(F.col(good), F.lit(False)).alias("b"))
    return a.join(b, key).where("a != b").select(key, F.when(F.col("b"), "fixed").otherwise("broken").alias("change"))


def label_counts(df: DataFrame, labels: Column, names: Sequence[str]) -> DataFrame:
    """``(label, n, pct)`` of multi-label rows in the order and number of ``names``; 0 where absent.

    ``pct`` is of all rows.  One pass: a conditional count per name, then a transposition.
    """
    held = F.coalesce(labels, F.array().cast("array<string>"))
    counts = df.agg(F.count("*").alias("rows"), *(F.count_if(F.array_contains(held, name)).alias(f"c{i}") for i, name in enumerate(names)))
    entries = F.explode(F.array(*(F.struct(F.lit(name).alias("label"), F.col(f"c{i}").alias("n")) for i, name in enumerate(names))))
    return counts.select("rows", entries.alias("e")).select("e.label", "e.n", F.round(percent(F.col("e.n"), F.col("rows")), 4).alias("pct"))


def taxonomy(df: DataFrame, predicates: Mapping[str, Column], key: str) -> DataFrame:
    """``(name, n, pct, example)`` of overlapping predicates in one pass; the example is the least key."""
    aggs = [F.count("*").alias("rows")]
    for i, test in enumerate(predicates.values()):
        test = F.coalesce(test, F.lit(False))
        aggs += [F.count_if(test).alias(f"c{i}"), F.min(F.when(test, F.col(key))).alias(f"x{i}")]
    entries = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"c{i}").alias("n"), F.col(f"x{i}").alias("example")) for i, name in enumerate(predicates))))
    return df.agg(*aggs).select("rows", entries.alias("e")).select("e.name", "e.n", "e.example", F.round(percent(F.col("e.n"), F.col("rows")), 4).alias("pct"))


def deltas(before: DataFrame, after: DataFrame, key: str, value: str, zero: float = 0.0) -> DataFrame:
    """``(key, before, after, change)`` with change up, down or same; absent counts as ``zero``."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    joined = a.join(b, key, "full").fillna(zero, ["before", "after"])
    change = F.when(F.col("after") > F.col("before"), "up").when(F.col("after") < F.col("before"), "down").otherwise("same")
    return joined.withColumn("change", change)


def share_of_total(df: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, total, share, place)``: groups by their part of the whole, largest first."""
    sums = df.groupBy(group).agg(F.sum(value).alias("total"))
    share = F.round(F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy())), 6)
    return sums.withColumn("share", share).withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), group)))


def slice_counts(df: DataFrame, slices: Mapping[str, Column], missing: str = "-") -> DataFrame:
    """``(slice, value, n)``: one count per value of every slice, in one pass over the rows."""
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("slice"), F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(missing)).alias("value")) for k, c in slices.items())))
    return df.select(parts.alias("s")).groupBy("s.slice", "s.value").agg(F.count("*").alias("n"))


def hit_rates(df: DataFrame, by: Sequence[str], rank: str, k: int) -> DataFrame:
    """``(n, hits, hit_rate, hit_at_1, mrr)``; a null rank is a miss and stays in the count."""
    r = F.col(rank)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(r <= k).alias("hits"),
        F.round(F.count_if(r <= k) / F.count("*"), 6).alias("hit_rate"),
        F.round(F.count_if(r == 1) / F.count("*"), 6).alias("hit_at_1"),
        F.round(F.avg(F.coalesce(F.when(r <= k, 1 / r), F.lit(0.0))), 6).alias("mrr"),
    )
