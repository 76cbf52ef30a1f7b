"""Attributes as they were valid and on record at an event's time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import shuffle_width

_FAR = 10_000_000  # later than any day number
_CHUNK = 32


def search_versions(event: np.ndarray, at: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index of each event's version, -1 where there is none.

    Versions are sorted by (owner, start, precedence).  A binary search gives the last
    version of the owner that starts by the event's day; where that one had ended or was
    not yet on record, all such events step back together, over whole chunks at once
    where no version of a chunk can serve.
    """
    found = np.full(len(at), -1, np.int64)
    if not len(owner) or not len(at):
        return found
    # the low part holds day numbers made positive, so a composite key sorts like (owner, start)
    shift = 1 << 25
    keys = owner.astype(np.int64) * (shift * 2) + (start.astype(np.int64) + shift // 2)
    i = np.searchsorted(keys, event.astype(np.int64) * (shift * 2) + (at.astype(np.int64) + shift // 2), "right") - 1
    first = np.searchsorted(owner, event, "left")
    edges = np.arange(0, len(owner), _CHUNK)
    chunk_end, chunk_known = np.maximum.reduceat(end, edges), np.minimum.reduceat(known, edges)
    open_ = np.flatnonzero(i >= first)
    while len(open_):
        j, day = i[open_], at[open_]
        fits = (known[j] <= day) & (end[j] >= day)
        found[open_[fits]] = j[fits]
        open_, j, day = open_[~fits], j[~fits], day[~fits]
        j = j - 1
        c = j // _CHUNK
        skip = (j >= 0) & ((chunk_end[c] < day) | (chunk_known[c] > day))
        i[open_] = np.where(skip, c * _CHUNK - 1, j)
        open_ = open_[i[open_] >= first[open_]]
    return found


def asof_lookup(
    events: DataFrame,
    versions: DataFrame,
    payload: list[str],
    block_days: int = 366,
    rows_per_group: int = 200_000,
) -> DataFrame:
    """``(entity, at, *payload)``: for every distinct ``(entity, at)`` of ``events`` the version
    valid and on record that day, latest ``start`` first, then highest ``rank``.

    ``versions(entity, start, end, known, rank, *payload)`` in day numbers; a null ``end`` is
    open, a null ``known`` never on record.  Null entities or days match nothing; ties in
    start and rank go to the larger payload, as text; empty inputs give no rows.

    Plan: events are reduced to distinct (entity, day) and versions to the best of each
    (entity, start, end, recording day), so a hot entity holds no more rows than there
    are days.  Both sides are cut into blocks of ``block_days``, a version goes to those of its
    blocks in which any event falls (a far sentinel day adds one block, not thousands), and
    both are co-grouped by a hash of (entity, block); each group is searched with numpy at once.
    """
    if {"entity", "at"} & set(payload):
        raise ValueError("entity and at are columns of the result already")
    spark = events.sparkSession
    names, payload = payload, [f"_p{i}" for i in range(len(payload))]
    versions = versions.select("entity", "start", "end", "known", "rank", *(F.col(n).alias(p) for n, p in zip(names, payload, strict=True)))
    events = events.where(F.col("entity").isNotNull() & F.col("at").isNotNull()).select("entity", "at")
    block = lambda c: F.floor(c / block_days).cast("int")
    blocks, rows = events.agg(F.sort_array(F.collect_set(block(F.col("at")))), F.count("*")).first()  # as many as the calendar has
    events = events.distinct()
    kinds = {f.name: f.dataType for f in versions.schema.fields}
    schema = T.StructType([T.StructField("entity", T.StringType()), T.StructField("at", T.IntegerType()), *(T.StructField(p, kinds[p]) for p in payload)])
    if not rows:
        return spark.createDataFrame([], schema).toDF("entity", "at", *names)
    place = F.struct("rank", F.to_json(F.struct(*payload)).alias("tie"))
    until = F.coalesce(F.col("end"), F.lit(_FAR)).cast("int")
    versions = (
        versions.where(F.col("entity").isNotNull() & F.col("start").isNotNull() & F.col("known").isNotNull())
        .select("entity", F.col("start").cast("int").alias("start"), until.alias("end"), F.col("known").cast("int").alias("known"), place.alias("place"), F.struct(*payload).alias("body"))
        .groupBy("entity", "start", "end", "known")
        .agg(F.max("place").alias("place"), F.max_by("body", "place").alias("body"))
        .select("entity", "start", "end", "known", "place.rank", "place.tie", *(f"body.{p}" for p in payload))
    )
    since, till = block(F.greatest("start", "known")), block(F.col("end"))
    met = F.filter(F.lit(np.array(blocks, np.int32)), lambda b: (b >= since) & (b <= till))
    versions = versions.withColumn("block", F.explode(met))
    events = events.withColumn("block", block(F.col("at")))
    groups = max(shuffle_width(events), -(-rows // rows_per_group))
    hashed = F.pmod(F.xxhash64("entity", "block"), F.lit(groups)).cast("int")

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        codes = pd.factorize(pd.concat([left["entity"], right["entity"]], ignore_index=True))[0]
        right = right.assign(code=codes[len(left) :]).sort_values(["code", "start", "rank", "tie"], kind="stable")
        hit = search_versions(codes[: len(left)], left["at"].to_numpy(), right["code"].to_numpy(), right["start"].to_numpy(), right["end"].to_numpy(), right["known"].to_numpy())
        got = hit >= 0
        rows = right.iloc[hit[got]]
        return pd.DataFrame({"entity": left["entity"].to_numpy()[got], "at": left["at"].to_numpy()[got], **{p: rows[p].to_numpy() for p in payload}})

    return (
        events.groupBy(hashed.alias("g"))
        .cogroup(versions.groupBy(hashed.alias("g")))
        .applyInPandas(find, schema)
        .toDF("entity", "at", *names)
    )
