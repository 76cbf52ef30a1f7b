"""References to records that are not on file at the referring record's time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import utc_month
from tidemark.operators.joins import HOT_PARTS, hot_keys, salted_join
from tidemark.session import cut


def reference_targets(df: DataFrame, target: str, key: str, first: str, deleted: str) -> DataFrame:
    """``(target, ref, first_at, gone_at)``: one row per clean key over all its rows."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.lit(target).alias("target"), F.col(key).alias("ref"))
        .agg(F.min(first).alias("first_at"), F.min(deleted).alias("gone_at"))
    )


def find_orphans(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct ``(src, rec_id, ref, kind, period)`` of dangling references.

    ``refs(src, rec_id, target, ref, at)``: null refs are no references.  ``kind`` is
    ``missing`` (no such target at all), ``late`` (it first appears after ``at``) or
    ``deleted`` (gone at or before ``at``).  A null ``at`` can only be ``missing``, with
    a null period.  Empty inputs give no rows, repeated references one row.

    Plan: foreign keys are reduced to distinct keys with the range of their times
    (partial aggregation, so a hot key costs one row per task); an anti-join finds the
    missing ones, a join the ones whose dates can clash; only these suspects are joined
    back to the references, salted where one key holds a large part of the rows.
    """
    refs = refs.select("src", "rec_id", "target", "ref", "at").where(F.col("ref").isNotNull())
    targets = targets.select("target", "ref", "first_at", "gone_at")
    keys = cut(refs.groupBy("target", "ref").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")))
    nothing = F.lit(None).cast("timestamp")
    missing = keys.join(targets, ["target", "ref"], "left_anti").select(
        "ref", "target", nothing.alias("first_at"), nothing.alias("gone_at"), F.lit(True).alias("absent")
    )
    clashing = (
        keys.join(targets, ["target", "ref"])
        .where((F.col("first_at") > F.col("lo")) | (F.col("gone_at") <= F.col("hi")))
        .select("ref", "target", "first_at", "gone_at", F.lit(False).alias("absent"))
    )
    suspects = missing.unionByName(clashing)
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = hot_keys(keys, "ref", total, HOT_PARTS)
    kind = (
        F.when(F.col("absent"), "missing")
        .when(F.col("first_at") > F.col("at"), "late")
        .when(F.col("gone_at") <= F.col("at"), "deleted")
    )
    return (
        salted_join(refs, suspects, ["ref", "target"], hot, F.col("rec_id"))
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select("src", "rec_id", "ref", "kind", utc_month(F.col("at")).alias("period"))
        .distinct()
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """References and referring records per table, period and kind."""
    return orphans.groupBy("src", "period", "kind").agg(
        F.count("*").alias("n_refs"), F.countDistinct("rec_id").alias("n_records"), F.countDistinct("ref").alias("n_keys")
    )
