"""Continuous periods and gaps of overlapping intervals."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, shuffle_width

_SHIFT, _SEG = 1_000_000, 32  # days are made positive; the segment stands above them


class Open(NamedTuple):
    """What the rows so far leave open: the last entity, its island and furthest end."""

    entity: str
    island: int
    end: int


def _merge(before: Open | None, after: Open | None) -> Open | None:
    """Associative: the state after the rows of both."""
    if before is None or after is None:
        return after or before
    if before.entity != after.entity:
        return after
    island = before.island if after.island <= before.end + 1 else after.island
    return Open(after.entity, island, max(before.end, after.end))


def _scan(entity: np.ndarray, s: np.ndarray, e: np.ndarray, state: Open | None):
    """One pass over sorted rows with the state carried into them.

    Returns rows (entity, is_gap, first, last) of the islands' parts and the gaps
    seen here, and the state carried out.
    """
    n = len(s)
    changed = np.empty(n, dtype=bool)
    changed[0] = state is None or entity[0] != state.entity
    changed[1:] = entity[1:] != entity[:-1]
    seg = np.cumsum(changed).astype(np.int64)
    reach = (seg << _SEG) + (e + _SHIFT)
    first = (0 << _SEG) + (state.end + _SHIFT if state else 0)
    upto = np.maximum.accumulate(np.concatenate(([first], reach)))
    before = upto[:-1]
    known = (before >> _SEG == seg) & ~changed
    end_before = (before & ((1 << _SEG) - 1)) - _SHIFT
    fresh = ~known | (s > end_before + 1)
    at = np.flatnonzero(fresh)
    heads = at if len(at) and at[0] == 0 else np.concatenate(([0], at))
    islands = s[heads].copy()
    if not fresh[0]:
        islands[0] = state.island
    ends = np.maximum.reduceat(e, heads)
    gaps = np.flatnonzero(fresh & known)
    rows = (
        np.concatenate((entity[heads], entity[gaps])),
        np.concatenate((np.zeros(len(heads), bool), np.ones(len(gaps), bool))),
        np.concatenate((islands, end_before[gaps] + 1)),
        np.concatenate((ends, s[gaps] - 1)),
    )
    return rows, Open(entity[-1], int(islands[-1]), int((upto[-1] & ((1 << _SEG) - 1)) - _SHIFT))


def merge_intervals(df: DataFrame, entity: str, first: str, last: str, partitions: int | None = None) -> DataFrame:
    """``(entity, kind, first, last)``: kind ``period`` or ``gap``, ends inclusive, day numbers.

    ``first`` and ``last`` are day numbers; intervals on consecutive days touch and are one
    period.  Rows with a null in any of the three, or ending before they start, are left
    out; repeated rows count once; an empty input gives no rows; other columns are ignored.

    Plan: intervals of one start are reduced to the longest, the rest is range-sorted by
    (entity, start), so that even one entity with most of the rows is spread over
    partitions.  Each partition gives one small summary (at most ``partitions`` rows reach
    the driver); their prefix combination is the state carried into each partition's
    second pass, which labels islands exactly.
    """
    spark = df.sparkSession
    rows = (
        df.select(F.col(entity).cast("string").alias("entity"), F.col(first).cast("int").alias("s"), F.col(last).cast("int").alias("e"))
        .where(F.col("entity").isNotNull() & (F.col("s") <= F.col("e")))
        .groupBy("entity", "s")
        .agg(F.max("e").alias("e"))
    )
    width = partitions or shuffle_width(df)
    rows = cut(
        rows.repartitionByRange(width, "entity", "s")
        .sortWithinPartitions("entity", "s")
        .withColumn("part", F.spark_partition_id())
    )

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, head, part = None, None, None
        for b in batches:
            if len(b):
                part = int(b["part"].iloc[0])
                head = b["entity"].iloc[0] if head is None else head
                _, state = _scan(b["entity"].to_numpy(object), b["s"].to_numpy(np.int64), b["e"].to_numpy(np.int64), state)
        if state:
            yield pd.DataFrame([(part, *state)], columns=["part", "entity", "island", "last"])

    carried: dict[int, Open | None] = {}
    state: Open | None = None
    for r in sorted(rows.mapInPandas(summarise, "part int, entity string, island int, last int").collect()):
        carried[r["part"]] = state
        state = _merge(state, Open(r["entity"], r["island"], r["last"]))
    carry = spark.sparkContext.broadcast(carried)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, begun = None, False
        for b in batches:
            if len(b):
                if not begun:
                    state, begun = carry.value[int(b["part"].iloc[0])], True
                found, state = _scan(b["entity"].to_numpy(object), b["s"].to_numpy(np.int64), b["e"].to_numpy(np.int64), state)
                yield pd.DataFrame(dict(zip(("entity", "gap", "first", "last"), found, strict=True)))

    parts = rows.mapInPandas(label, "entity string, gap boolean, first int, last int")
    return (
        parts.groupBy("entity", "gap", "first")
        .agg(F.max("last").alias("last"))
        .select("entity", F.when(F.col("gap"), "gap").otherwise("period").alias("kind"), "first", "last")
    )
