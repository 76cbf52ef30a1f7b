"""Columnar shredding of nested records with repetition and definition levels."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Levels(NamedTuple):
    """The column of one leaf path over a batch of records.

    ``row`` is the record's place in the batch, ``rep`` the nesting depth at which the
    entry repeats (0 opens a record), ``depth`` how many of the path's optional or
    repeated steps are there, ``values`` the leaf values of the entries that reach
    ``full``, in order.
    """

    row: np.ndarray
    rep: np.ndarray
    depth: np.ndarray
    values: pa.Array
    full: int
    lists: tuple[int, ...]  # depth from which an entry of each list exists


def _json_list(texts: pa.Array, field: str) -> pa.Array:
    """``field`` of JSON object texts as list<string>; a bare value is a list of one.

    Text that is a JSON string is decoded once more.  Incomplete JSON, other documents
    than objects, and an absent or null field give null.
    """

    def text(v: Any) -> str | None:
        if v is None:
            return None
        v = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        return v.encode("utf-8", "replace").decode("utf-8")

    def decode(raw: str | None) -> list[str | None] | None:
        try:
            doc = json.loads(raw) if raw is not None else None
            doc = json.loads(doc) if isinstance(doc, str) else doc
        except (ValueError, RecursionError):
            return None
        found = doc.get(field) if isinstance(doc, dict) else None
        if found is None:
            return None
        return [text(x) for x in found] if isinstance(found, list) else [text(found)]

    return pa.array(map(decode, texts.to_pylist()), pa.list_(pa.string()))


def shred(column: pa.Array, path: Sequence[str]) -> Levels:
    """Levels of one leaf.  Path steps: ``[]`` enters a list, ``name`` a struct's field,
    ``{name}`` a field of JSON text (as a list of strings)."""
    n = len(column)
    row, idx, alive = np.arange(n), np.arange(n), np.ones(n, bool)
    rep, depth = np.zeros(n, np.int16), np.zeros(n, np.int16)
    level, nesting, lists, cur = 0, 0, [], column

    def optional() -> None:
        nonlocal alive, level
        valid = cur.is_valid().to_numpy(zero_copy_only=False)
        alive = alive & (valid[np.where(alive, idx, 0)] if len(valid) else False)
        depth[alive] += 1
        level += 1

    for step in path:
        optional()
        if step == "[]":
            offsets, nesting = cur.offsets.to_numpy(), nesting + 1
            safe = np.where(alive, idx, 0)
            sizes = np.where(alive, offsets[safe + 1] - offsets[safe], 0) if len(cur) else np.zeros(len(idx), np.int64)
            times = np.maximum(sizes, 1)
            starts = np.cumsum(times) - times
            nth = np.arange(times.sum()) - np.repeat(starts, times)
            base = np.where(alive, offsets[safe], 0) if len(cur) else np.zeros(len(idx), np.int64)
            row, depth = np.repeat(row, times), np.repeat(depth, times)
            rep = np.where(nth == 0, np.repeat(rep, times), nesting).astype(np.int16)
            alive, idx = np.repeat(sizes > 0, times), np.repeat(base, times) + nth
            depth[alive] += 1
            level += 1
            lists.append(level)
            cur = cur.values
        elif step.startswith("{"):
            cur = _json_list(cur, step[1:-1])
        else:
            cur = cur.field(step)
    optional()
    return Levels(row, rep, depth, cur.take(pa.array(idx[alive])), level, tuple(lists))


def positions(levels: Levels) -> list[np.ndarray]:
    """The place of every entry in each of the path's lists, from repetition levels alone."""
    found, order = [], np.arange(len(levels.rep))
    for k in range(1, len(levels.lists) + 1):
        opens = np.maximum.accumulate(np.where(levels.rep < k, order, 0)) if len(order) else order
        steps = np.cumsum(levels.rep <= k)
        found.append((steps - steps[opens]).astype(np.int32) if len(order) else order.astype(np.int32))
    return found


def flatten_leaf(df: DataFrame, key: str, column: str, path: Sequence[str], absent: int = -1) -> DataFrame:
    """``(rec_id, lvl1, lvl2, ..., val)``: the non-null values of a leaf with their places.

    Shreds the column batch by batch and reassembles the leaf's rows from the level
    sequences; no shuffle, no row ever leaves its task.  There is a place for each list of
    the path, null elements counted; ``lvl2`` is ``absent`` where it has one list only.
    Null or empty lists, null elements and null leaves give no row; records with a null
    key keep it; an empty input gives no rows.
    """
    names = [f"lvl{k + 1}" for k in range(max(2, list_steps(path)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = shred(batch.column(1), path)
            there = levels.depth == levels.full
            places = [p[there] for p in positions(levels)]
            places += [np.full(int(there.sum()), absent, np.int32)] * (len(names) - len(places))
            keys = batch.column(0).take(pa.array(levels.row[there]))
            yield pa.RecordBatch.from_arrays([keys.cast(pa.string()), *map(pa.array, places), levels.values.cast(pa.string())], ["rec_id", *names, "val"])

    return df.select(key, column).mapInArrow(run, f"rec_id string, {', '.join(f'{n} int' for n in names)}, val string")


def list_steps(path: Sequence[str]) -> int:
    return sum(step == "[]" for step in path)


def ancestor_table(df: DataFrame, key: str, column: str, path: Sequence[str], leaves: Mapping[str, str]) -> DataFrame:
    """``(rec_id, lvl1, ..., *leaves)``: one row for every element of the list that ``path`` ends in.

    ``leaves`` are fields of the element with their types.  Each leaf is shredded on its own
    and the rows are put together from the level sequences, which agree up to the list; a
    place for each list of the path ties a row to its parents' rows, whose tables have the
    same places.  Elements without children and null elements keep their row, with nulls;
    null and empty lists have no elements.  Records with a null key keep it; repeated
    records give repeated rows; no shuffle.
    """
    if not path or path[-1] != "[]":
        raise ValueError("the path of a repeated ancestor ends in a list")
    names = [f"lvl{k + 1}" for k in range(list_steps(path))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shred(batch.column(1), (*path, leaf)) for leaf in leaves]
            first = parts[0]
            there = first.depth >= first.lists[-1]
            columns = [batch.column(0).take(pa.array(first.row[there])).cast(pa.string()), *(pa.array(p[there]) for p in positions(first))]
            for levels in parts:
                full = levels.depth == levels.full
                at = np.where(full, np.cumsum(full) - 1, -1)[there]
                columns.append(levels.values.take(pa.array(at, mask=at < 0)))
            yield pa.RecordBatch.from_arrays(columns, ["rec_id", *names, *leaves])

    head = ", ".join([*(f"{n} int" for n in names), *(f"`{n}` {kind}" for n, kind in leaves.items())])
    return df.select(key, column).mapInArrow(run, f"rec_id string, {head}")


def leaf_levels(df: DataFrame, key: str, column: str, path: Sequence[str]) -> DataFrame:
    """``(rec_id, rep, depth, val)``: a leaf's whole level sequence, one row per entry in order
    of ``seq``; what a columnar file would store.  ``val`` is null below the full depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = shred(batch.column(1), path)
            there = levels.depth == levels.full
            place = np.where(there, np.cumsum(there) - 1, -1)
            values = levels.values.cast(pa.string()).take(pa.array(place, mask=~there))
            order = np.arange(len(levels.row))
            head = np.maximum.accumulate(np.where(levels.rep == 0, order, 0)) if len(order) else order
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(levels.row)).cast(pa.string()), pa.array((order - head).astype(np.int32)), pa.array(levels.rep.astype(np.int32)), pa.array(levels.depth.astype(np.int32)), values],
                ["rec_id", "seq", "rep", "depth", "val"],
            )

    return df.select(key, column).mapInArrow(run, "rec_id string, seq int, rep int, depth int, val string")
