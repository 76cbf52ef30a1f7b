"""Exact order statistics of groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut, shuffle_width

#: Picks turn a group's size into the zero-based place of the wanted value in sorted order.
Pick = Callable[[Column], Column]


def nearest_rank(p: float) -> Pick:
    """The smallest value with at least ``p`` percent of the values at or below it."""
    return lambda n: F.greatest(F.ceil(F.lit(p) * n / 100), F.lit(1)) - 1


def rounded_index(p: float) -> Pick:
    """The value at index ``p * (n - 1)`` rounded half up."""
    return lambda n: F.floor(F.lit(p) * (n - 1) + 0.5)


LOWER_MIDDLE: Pick = lambda n: F.floor((n - 1) / 2)
UPPER_MIDDLE: Pick = lambda n: F.floor(n / 2)


def order_statistics(df: DataFrame, groups: Sequence[str], value: str, picks: Mapping[str, Pick]) -> DataFrame:
    """``(*groups, n, *picks)``: the values at the picked places of each group, exactly.

    Null and NaN values are left out; a null group is a group; groups without values give no
    row.  Plan: one range sort by (group, value), so a hot group spans many partitions;
    partition sizes (at most partitions + groups rows) give the global places, and only the
    picked rows are joined back by their row number.
    """
    usable = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    rows = df.where(usable).select(F.struct(*groups).alias("g"), F.col(value).alias("v"))
    rows = cut(
        rows.repartitionByRange(shuffle_width(df), "g", "v").sortWithinPartitions("g", "v")
        .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    )
    runs = rows.groupBy("g", "part").agg(F.count("*").alias("c"), F.min("row").alias("first"))
    over = Window.partitionBy("g")
    runs = runs.withColumn("n", F.sum("c").over(over)).withColumn("before", F.sum("c").over(over.orderBy("part")) - F.col("c"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("pick"), pick(F.col("n")).cast("long").alias("place")) for name, pick in picks.items())))
    targets = (
        runs.select("g", "n", "before", "c", "first", wanted.alias("w"))
        .where((F.col("w.place") >= F.col("before")) & (F.col("w.place") < F.col("before") + F.col("c")))
        .select("g", "n", F.col("w.pick").alias("pick"), (F.col("first") + F.col("w.place") - F.col("before")).alias("row"))
    )
    found = targets.join(rows.select("row", "v"), "row").groupBy("g", "n").pivot("pick", list(picks)).agg(F.first("v"))
    return found.select(*(F.col(f"g.{g}").alias(g) for g in groups), "n", *picks)


def iqr_outliers(df: DataFrame, groups: Sequence[str], value: str, width: float = 1.5, fallback: int = 3) -> DataFrame:
    """Rows outside ``width`` interquartile ranges of their group, with ``side`` low or high.

    Quartiles are at rounded indexes.  A group without such rows gives its ``fallback`` lowest
    and highest instead (side ``lowest`` / ``highest``; ties by the other columns).  Rows
    without a value are never outliers.
    """
    picks = {"q1": rounded_index(0.25), "q3": rounded_index(0.75)}
    fences = order_statistics(df, groups, value, picks)
    same = lambda a, b: [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in groups]
    spread = width * (F.col("q3") - F.col("q1"))
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).alias("r").join(fences.alias("f"), same("r", "f"))
    side = F.when(F.col(f"r.{value}") < F.col("q1") - spread, "low").when(F.col(f"r.{value}") > F.col("q3") + spread, "high")
    marked = rows.select("r.*", side.alias("side"))
    outside = marked.where("side IS NOT NULL")
    calm = fences.alias("f").join(outside.select(*groups).distinct().alias("o"), same("f", "o"), "left_anti").select(*groups)
    still = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).alias("r").join(calm.alias("c"), same("r", "c"), "left_semi")
    order = sorted(df.columns)
    edges = []
    for name, key in (("lowest", F.col(value).asc()), ("highest", F.col(value).desc())):
        place = F.row_number().over(Window.partitionBy(*groups).orderBy(key, *order))
        edges.append(still.withColumn("_n", place).where(F.col("_n") <= fallback).drop("_n").withColumn("side", F.lit(name)))
    return outside.unionByName(edges[0]).unionByName(edges[1])
