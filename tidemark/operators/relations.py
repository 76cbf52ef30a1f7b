"""Joins and set operations of run, reference and policy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the last in ``order``: an aggregation, so a key with most of the
    rows costs one row per task.  Columns must be orderable or hashable to travel in a struct."""
    body = F.struct(*df.columns)
    best = df.groupBy(*keys).agg(F.max_by(body, F.struct(*order)).alias("b"))
    return best.select("b.*")


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that are not done yet; a null key is never done."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def resume(items: DataFrame, done: DataFrame, key: str, marks: Sequence[str]) -> DataFrame:
    """What is still to do of ``items``: those not ``done``, if everything done was done under the
    marks (fingerprints of the inputs) that the items have now; else all of them.

    ``marks`` are columns of both; those of the items must agree.  Nothing done leaves all.
    """
    now = items.select(*marks).distinct()
    foreign = done.select(*marks).distinct().exceptAll(now).agg((F.count("*") > 0).alias("_foreign"))
    kept = done.select(key).distinct().join(F.broadcast(foreign)).where(~F.col("_foreign")).select(key)  # one row
    return items.join(kept, key, "left_anti")


def complete_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails when an item of ``left`` has no partner in ``right``."""
    there = right.withColumn("_there", F.lit(True))
    joined = left.join(there, key, "left")
    sure = F.when(F.col("_there"), True).otherwise(F.raise_error(F.concat(F.lit("no partner for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return joined.where(sure).drop("_there")


def first_available(key: str, value: str, *runs: DataFrame) -> DataFrame:
    """``(key, value, source)``: per item of the first run the value of the last run that has it."""
    base = runs[0].select(key, F.col(value).alias("v0"))
    for i, run in enumerate(runs[1:], 1):
        base = base.join(run.select(key, F.col(value).alias(f"v{i}")), key, "left")
    order = [F.col(f"v{i}") for i in reversed(range(len(runs)))]
    source = F.coalesce(*(F.when(c.isNotNull(), F.lit(len(runs) - 1 - i)) for i, c in enumerate(order)))
    return base.select(key, F.coalesce(*order).alias(value), source.alias("source"))


def covering_interval(points: DataFrame, intervals: DataFrame, key: str, at: str, first: str, last: str, rank: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Left range join: each point with the first interval (by ``rank``) of its key that holds it.

    An equi-join on the key with the range as residual; the choice is an aggregation over
    the point's own columns.  Points without an interval stay, with nulls.
    """
    cols = points.columns
    hit = F.col(at).between(F.col(first), F.col(last))
    rows = points.join(intervals.select(F.col(key).alias("_k"), first, last, *rank, *[k for k in keep if k not in (first, last)]), (F.col(key) == F.col("_k")) & hit, "left")
    best = F.min_by(F.struct(*keep), F.struct(*rank))
    return rows.groupBy(*cols).agg(F.when(F.count("_k") > 0, best).alias("b")).select(*cols, *(F.col(f"b.{k}").alias(k) for k in keep))


def violations(claims: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``claims`` whose key combination is not allowed."""
    return claims.join(allowed.select(*keys).distinct(), list(keys), "left_anti")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, n)`` of keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def lookup_status(asked: DataFrame, table: DataFrame, key: str, pattern: str) -> DataFrame:
    """``asked`` with ``status``: ``malformed`` key, ``not found``, or ``ok``."""
    known = table.select(key).distinct().withColumn("_known", F.lit(True))
    status = F.when(~F.coalesce(F.col(key).rlike(pattern), F.lit(False)), "malformed").when(F.col("_known").isNull(), "not found").otherwise("ok")
    return asked.join(known, key, "left").withColumn("status", status).drop("_known")


def reading_order(df: DataFrame, items: str, item_key: str, corpus: DataFrame, corpus_key: str, text: str, keys: Sequence[str], sep: str) -> DataFrame:
    """``(*keys, context, missing)``: the texts of an ordered list of references, joined in order,
    and how many of them the corpus does not have."""
    refs = df.select(*keys, F.posexplode_outer(items).alias("_pos", "_item")).withColumn("_ref", F.col(f"_item.{item_key}") if item_key else F.col("_item"))
    joined = refs.join(corpus.select(F.col(corpus_key).alias("_ref"), F.col(text).alias("_text")), "_ref", "left")
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("_text").isNotNull(), F.struct("_pos", "_text")))), lambda x: x["_text"])
    return joined.groupBy(*keys).agg(F.concat_ws(sep, parts).alias("context"), F.count_if(F.col("_ref").isNotNull() & F.col("_text").isNull()).alias("missing"))


def ranked(df: DataFrame, by: Sequence[str], score: Column, tie: Sequence[str], k: int | None = None) -> DataFrame:
    """Rows with their ``rank`` by score, ties by ``tie``; the first ``k`` where given."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(score.desc(), *tie)))
    return out.where(F.col("rank") <= k) if k else out


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows, the same for the same seed and data, whatever the partitioning."""
    return df.orderBy(F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), 256), key).limit(n)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of each stratum, by seeded hash order."""
    draw = F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), 256)
    return ranked(df.withColumn("_d", draw), [stratum], F.lit(0), ["_d", key], n).drop("_d", "rank")


def by_id(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key; an error when there are none."""
    found = df.where(F.col(key) == value)
    n = found.agg(F.count("*").alias("_n"))
    sure = F.when(F.col("_n") > 0, True).otherwise(F.raise_error(F.lit(f"no {key} {value}")).cast("boolean"))
    return n.where(sure).join(found).drop("_n")  # one row on the left


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key out of what is there and what comes in, the last in ``order``."""
    return latest_per_key(current.unionByName(changes, allowMissingColumns=True), keys, order)


def containing_texts(texts: DataFrame, key: str, text: str, markers: DataFrame, marker: str, pattern: str) -> DataFrame:
    """``(key, marker)``: markers that stand in a text.  Both sides are joined on the tokens that
    ``pattern`` finds in the texts, not compared pair by pair."""
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias(marker))
    return found.join(markers.select(marker).distinct(), marker).select(key, marker)


def last_best(df: DataFrame, by: Sequence[str], score: str, index: str, keep: str) -> DataFrame:
    """``(*by, keep)`` of the highest score; of equal ones that of the highest index."""
    return df.groupBy(*by).agg(F.max_by(keep, F.struct(score, index)).alias(keep))
