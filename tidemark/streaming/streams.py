"""Incremental processing: resumable appends, day-rolling sinks, windows and stateful budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append", partition: list[str] | None = None) -> None:
    """Processes what is there and stops; a second run with the same checkpoint takes only
    what is new, each row once."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if partition:
        writer = writer.partitionBy(*partition)
    writer.start(out).awaitTermination()


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def parquet_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tumbling(df: DataFrame, ts: str, width: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window; rows later than ``late`` are dropped by the watermark."""
    return (
        df.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")
    )


def sliding(df: DataFrame, ts: str, width: str, step: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    return (
        df.withWatermark(ts, late).groupBy(F.window(ts, width, step).alias("w"), *by)
        .agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
    )


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    return (
        df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by)
        .agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
    )


def once_per_key(df: DataFrame, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def with_memo(df: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no recorded verdict yet: a stream against a static table."""
    return df.join(verdicts.select(key).distinct(), key, "left_anti")


def budget_stops(df: DataFrame, key: str, cost: str, most: float) -> DataFrame:
    """``(key, n, spent)`` when a key's running cost first reaches ``most``; the state is one
    row per key, whatever its number of events.  Later events of a stopped key give nothing.

    Within a batch events count together: the stop is noticed at the batch that reaches it.
    """
    kind = df.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, spent, stopped = state.get if state.exists else (0, 0.0, False)
        for b in batches:
            n, spent = n + len(b), spent + float(b[cost].fillna(0).sum())
        fire = not stopped and spent >= most
        state.update((n, spent, stopped or fire))
        if fire:
            yield pd.DataFrame({key: [k[0]], "n": [n], "spent": [spent]})

    return df.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, n bigint, spent double", "n bigint, spent double, stopped boolean", "append", GroupStateTimeout.NoTimeout)
