"""Percentiles of numeric columns from dyadic count-sketches, which add and subtract."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 32  # of the value code: sign, exponent and 20 bits of mantissa
DEPTH, WIDTH = 5, 1024
EXACT = 12  # levels with at most 2**EXACT nodes are counted without hashing
HASHED = BITS - EXACT
_HASHED_CELLS = HASHED * DEPTH * WIDTH
#: Cells of a whole sketch; its size does not depend on the data.
CELLS = _HASHED_CELLS + 2 ** (EXACT + 1)
#: Standard deviations of the noise that the bound of a rank allows for.
SIGMAS = 5.0


def encode_values(x: np.ndarray) -> np.ndarray:
    """Codes in the order of the values: the upper half of the order-preserving bits."""
    bits = np.asarray(x, np.float64).view(np.uint64).copy()
    negative = bits >> np.uint64(63) == 1
    bits = np.where(negative, ~bits, bits | np.uint64(1 << 63))
    return (bits >> np.uint64(64 - BITS)).astype(np.uint64)


def decode_values(code: np.ndarray) -> np.ndarray:
    """The middle of a code's range of values; zero for the range that holds it."""
    bits = (np.asarray(code, np.uint64) << np.uint64(64 - BITS)) | np.uint64(1 << (63 - BITS))
    bits = np.where(bits >> np.uint64(63) == 1, bits & np.uint64((1 << 63) - 1), ~bits)
    found = bits.view(np.float64)
    return np.where(np.abs(found) < np.finfo(np.float64).tiny, 0.0, found)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(node: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and sign of nodes in one row of one hashed level."""
    with np.errstate(over="ignore"):
        h = _mix(node.astype(np.uint64) + np.uint64((level * DEPTH + row + 1) * 0x9E3779B97F4A7C15 % 2**64))
    cell = (level * DEPTH + row) * WIDTH + (h & np.uint64(WIDTH - 1)).astype(np.int64)
    return cell, 1 - 2 * (h >> np.uint64(63)).astype(np.int64)


def _exact_start(level: int) -> int:
    """First cell of an exact level; the coarser the level, the fewer cells."""
    return _HASHED_CELLS + sum(2 ** (BITS - k) for k in range(HASHED, level))


def add_values(cells: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> None:
    """Add weighted codes to a dense sketch in place; negative weights take away."""
    node, inverse = np.unique(codes, return_inverse=True)
    weight = np.bincount(inverse, weights).astype(np.int64)
    for level in range(BITS):
        if level < HASHED:
            for row in range(DEPTH):
                cell, sign = _place(node, level, row)
                base = (level * DEPTH + row) * WIDTH
                cells[base : base + WIDTH] += np.bincount(cell - base, weight * sign, WIDTH).astype(np.int64)
        else:
            start = _exact_start(level)
            cells[start : start + 2 ** (BITS - level)] += np.bincount(node.astype(np.int64), weight, 2 ** (BITS - level)).astype(np.int64)
        half = node >> np.uint64(1)
        first = np.flatnonzero(np.diff(half, prepend=np.uint64(2**63)))
        node, weight = half[first], np.add.reduceat(weight, first)


def estimate(cells: np.ndarray, level: int, node: np.ndarray) -> np.ndarray:
    """Count of nodes: the median over the rows, exact on the coarse levels."""
    if level >= HASHED:
        return cells[_exact_start(level) + node.astype(np.int64)].astype(float)
    rows = []
    for row in range(DEPTH):
        cell, sign = _place(node, level, row)
        rows.append(cells[cell] * sign)
    return np.median(np.stack(rows), axis=0)


def level_noise(cells: np.ndarray, level: int) -> float:
    """The standard deviation of an estimate of a hashed level, 0 for exact ones.

    What an estimate is off by is what others left in its cells, so the noise is measured in
    the sketch itself: the medians over the rows of cells that belong to no common node.
    """
    if level >= HASHED:
        return 0.0
    rows = cells[level * DEPTH * WIDTH : (level + 1) * DEPTH * WIDTH].reshape(DEPTH, WIDTH).astype(float)
    signs = 1.0 - 2.0 * (_mix(np.arange(DEPTH * WIDTH, dtype=np.uint64)) & np.uint64(1)).astype(float).reshape(DEPTH, WIDTH)
    return float(np.sqrt(np.mean(np.median(rows * signs, axis=0) ** 2)))


def invert(cells: np.ndarray, quantiles: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The count, the values at nearest ranks, descending from the root, and for each the bound
    of its rank's error: ``SIGMAS`` deviations of the noise of all levels together, which is
    independent from level to level; of a level no more than the node's whole count."""
    n = int(cells[_exact_start(BITS - 1)] + cells[_exact_start(BITS - 1) + 1])
    if n <= 0:
        return 0, np.full(len(quantiles), np.nan), np.full(len(quantiles), np.nan)
    rank = np.maximum(np.ceil(quantiles * n), 1.0)
    node, count = np.zeros(len(quantiles), np.uint64), np.full(len(quantiles), float(n))
    off = np.zeros(len(quantiles))
    for level in range(BITS - 1, -1, -1):
        off += np.minimum(SIGMAS * level_noise(cells, level), count) ** 2
        left = node << np.uint64(1)
        a, b = np.maximum(estimate(cells, level, left), 0), np.maximum(estimate(cells, level, left + np.uint64(1)), 0)
        a = np.where(a + b > 0, count * a / np.maximum(a + b, 1e-9), count)
        right = rank > a + 1e-9
        rank = np.where(right, rank - a, rank)
        count = np.where(right, count - a, a)
        node = left + right.astype(np.uint64)
    return n, decode_values(node), np.minimum(np.sqrt(off) / n, 1.0)


def build_sketch(df: DataFrame, groups: Sequence[str], value: str, weight: str | None = None, held: int = 8) -> DataFrame:
    """``(*groups, cell, n)``: the sketch of ``value`` per group as sparse cells.

    Null and NaN values are left out; infinities and zeros count; a null group is a group.
    ``weight`` (1 where not given) may be negative to delete.  An empty input gives no rows.

    Plan: the input is read once and its rows stay where they are: each task sorts its own by
    group and gives out one partial sketch a group, so a hot group is spread as its rows are.
    A task holds at most ``held`` dense sketches (under 1 MB each); cells are summed with
    partial aggregation, a sum that later sketches can join.
    """
    kinds = {f.name: f for f in df.schema.fields}
    group_type = T.StructType([kinds[g] for g in groups])
    key = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"})
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(key.alias("g"), F.col(value).cast("double").alias("v"), w.alias("w"))
    rows = rows.sortWithinPartitions("g")

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense: dict[str, np.ndarray] = {}

        def drained() -> Iterator[pd.DataFrame]:
            for g, cells in dense.items():
                cell = np.flatnonzero(cells)
                yield pd.DataFrame({"g": g, "cell": cell.astype(np.int32), "n": cells[cell]})
            dense.clear()

        for b in batches:
            codes, weights = encode_values(b["v"].to_numpy()), b["w"].to_numpy(np.int64)
            which, names = pd.factorize(b["g"])
            order = np.argsort(which, kind="stable")
            for name, at in zip(names, np.split(order, np.cumsum(np.bincount(which))[:-1]), strict=True):
                if name not in dense:
                    if len(dense) >= held:
                        yield from drained()
                    dense[name] = np.zeros(CELLS, np.int64)
                add_values(dense[name], codes[at], weights[at])
        yield from drained()

    cells = rows.mapInPandas(sketch, "g string, cell int, n bigint").groupBy("g", "cell").agg(F.sum("n").alias("n"))
    return cells.where("n != 0").select(F.from_json("g", group_type).alias("g"), "cell", "n").select(*(F.col(f"g.{g}").alias(g) for g in groups), "cell", "n")


def merge_sketches(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The sketch of all rows together, from sketches of the parts; columns other than the
    groups both have in common must have been dropped before."""
    groups = [c for c in first.columns if c not in ("cell", "n")]
    for other in others:
        first = first.unionByName(other)
    return first.groupBy(*groups, "cell").agg(F.sum("n").alias("n")).where("n != 0")


def sketch_percentiles(sketch: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """``(*groups, q, value, n, rank_error)`` by rank inversion; a sketch has at most ``CELLS`` rows
    a group.  The rank of ``value`` is within ``rank_error`` of the count of the one asked for
    (``SIGMAS`` standard deviations of the noise in the group's own sketch), the value itself within a factor of 2**-20."""
    groups = [c for c in sketch.columns if c not in ("cell", "n")]
    kinds = {f.name: f for f in sketch.schema.fields}
    group_type = T.StructType([kinds[g] for g in groups])
    qs = np.array(sorted(quantiles))

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros(CELLS, np.int64)
        cells[pdf["cell"].to_numpy()] = pdf["n"].to_numpy()
        n, values, off = invert(cells, qs)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "q": qs, "value": values, "n": n, "rank_error": off})

    key = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"})
    found = sketch.select(key.alias("g"), "cell", "n").groupBy("g").applyInPandas(descend, "g string, q double, value double, n bigint, rank_error double")
    return found.where("n > 0").select(F.from_json("g", group_type).alias("g"), "q", "value", "n", "rank_error").select(*(F.col(f"g.{g}").alias(g) for g in groups), "q", "value", "n", "rank_error")
