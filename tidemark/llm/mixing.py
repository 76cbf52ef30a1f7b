"""Mixtures of sources with target shares of the total size, drawn by the cube method."""

from __future__ import annotations

import math
import random
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import strip
from tidemark.session import cut

_EPS = 1e-9


def clean_source(c: Column) -> Column:
    """Lower case, trimmed, underscores for blanks and hyphens; null and blank give null."""
    c = F.lower(F.regexp_replace(strip(c), r"[\s\-]+", "_"))
    return F.when(c != "", c)


class Share(NamedTuple):
    """What a source has and gets: each document ``base`` times, and once more with ``chance``."""

    source: str
    target_share: float
    max_repeats: int
    docs: int
    tokens: int
    base: int
    chance: float


def plan_shares(targets: list[tuple[str, float, int]], stock: dict[str, tuple[int, int]], total: float | None = None) -> list[Share]:
    """Rates that give every source its share of the largest total the caps allow.

    ``stock`` is (documents, tokens) by source.  Sources without a target take no part; the
    shares of targets without tokens fall to the others in proportion.  ``total`` asks for a
    smaller set.
    """
    live = {s: (w, r) for s, w, r in targets if w > 0 and r > 0 and stock.get(s, (0, 0))[1] > 0}
    whole = sum(w for w, _ in live.values())
    most = min((r * stock[s][1] * whole / w for s, (w, r) in live.items()), default=0.0)
    size = min(most, total) if total else most
    plan = []
    for s, w, r in targets:
        docs, tokens = stock.get(s, (0, 0))
        rate = min(size * w / whole / tokens, r) if s in live else 0.0
        base = math.floor(rate + _EPS)
        plan.append(Share(s, w, r, docs, tokens, base, max(0.0, rate - base)))
    return plan


def flight(chance: np.ndarray, size: np.ndarray, rng: random.Random, count: bool = True) -> np.ndarray:
    """Moves chances to 0 or 1, keeping the size they add up to and, with ``count``, their sum.

    A few units at a time (one more than there are constraints) move along the null space
    of the constraints, with a direction drawn so that every chance keeps its mean, until
    one of them is decided; at the end fewer units than that stay open.
    """
    p, x, k = chance.tolist(), size.tolist(), 3 if count else 2
    open_: list[int] = []
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = float(round(p[i]))
            continue
        open_.append(i)
        while len(open_) == k or len(open_) == 2 and x[open_[0]] == x[open_[1]]:
            if len(open_) == 2:
                move = (x[open_[1]], -x[open_[0]]) if x[open_[0]] != x[open_[1]] else (1.0, -1.0)
            else:
                a, b, c = (x[j] for j in open_)
                move = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
            up = min((1 - p[j]) / u if u > 0 else p[j] / -u for j, u in zip(open_, move, strict=True) if u)
            down = min(p[j] / u if u > 0 else (1 - p[j]) / -u for j, u in zip(open_, move, strict=True) if u)
            step = up if rng.random() * (up + down) < down else -down
            for j, u in zip(open_, move, strict=True):
                p[j] += step * u
                if p[j] < _EPS or p[j] > 1 - _EPS:
                    p[j] = float(round(p[j]))
            open_ = [j for j in open_ if _EPS < p[j] < 1 - _EPS]
    return np.array(p)


def settle(p: np.ndarray, size: np.ndarray, want: float, near: float = 0.0, rounds: int = 4000) -> np.ndarray:
    """Turns units of 0 and 1 over, one or a pair of opposite ones at a time, as long as that
    brings the size nearer to ``want``, until it is as ``near`` as is asked."""
    p = p.copy()
    for _ in range(rounds):
        miss = want - float((p * size).sum())
        if abs(miss) <= near:
            break
        into, out = np.flatnonzero((p < 0.5) & (size > 0)), np.flatnonzero((p > 0.5) & (size > 0))
        moves = [(abs(miss), ())]
        if len(into):
            i = into[np.argmin(np.abs(miss - size[into]))]
            moves.append((abs(miss - size[i]), (i,)))
        if len(out):
            i = out[np.argmin(np.abs(miss + size[out]))]
            moves.append((abs(miss + size[i]), (i,)))
        if len(into) and len(out):
            by_size = into[np.argsort(size[into], kind="stable")]
            at = np.searchsorted(size[by_size], size[out] + miss)
            for beside in (np.clip(at - 1, 0, len(by_size) - 1), np.clip(at, 0, len(by_size) - 1)):
                left = np.abs(miss - size[by_size[beside]] + size[out])
                i = int(np.argmin(left))
                moves.append((float(left[i]), (out[i], by_size[beside[i]])))
        left, turn = min(moves, key=lambda m: (m[0], len(m[1])))
        if not turn or left > abs(miss) - _EPS:
            break
        for i in turn:
            p[i] = 1 - p[i]
    return p


def land(chance: np.ndarray, size: np.ndarray, rng: random.Random) -> np.ndarray:
    """Decides the units still open: the count is let go, the size alone balanced, large units
    first; what the last one misses is made up by turning over units of the right size."""
    p, at = np.round(chance), np.flatnonzero((chance > _EPS) & (chance < 1 - _EPS))
    at = at[np.argsort(-size[at], kind="stable")]
    want = float((chance[at] * size[at]).sum())
    p[at] = settle(np.round(flight(chance[at], size[at], rng, count=False)), size[at], want)
    return p


class Hand:
    """The documents of a source that are drawn one by one: all of a source of up to ``HAND``
    documents, else those of more than 1/``HAND`` of its tokens (so there are fewer than that).
    ``rest`` are the tokens of the others, which fly and can make up any amount up to that."""

    def __init__(self, sizes: list[int], rest: float):
        self.size, self.rest = np.array(sizes, float), float(rest)
        self.unit = max(1, math.ceil(sum(sizes) / 2**20))
        self.steps = [round(x / self.unit) for x in sizes]
        reach = 1
        for x in self.steps:
            reach |= reach << x
        bits = np.frombuffer(reach.to_bytes(reach.bit_length() // 8 + 1, "little"), np.uint8)
        self.sums = np.flatnonzero(np.unpackbits(bits, bitorder="little")) * float(self.unit)

    def nearest(self, amount: float) -> float:
        """The size of a draw from the hand that leaves the least to be missed of ``amount``;
        where the rest can take part, about its due part of the amount."""
        due = amount * self.size.sum() / max(1.0, self.size.sum() + self.rest)
        miss = np.maximum(self.sums - amount, 0) + np.maximum(amount - self.rest - self.sums, 0)
        best = self.sums[miss <= miss.min() + _EPS]
        return float(best[np.argmin(np.abs(best - due))])

    def miss(self, amount: float) -> float:
        got = self.nearest(amount)
        return max(got - amount, amount - self.rest - got, 0.0)

    def draw(self, chance: float, rng: random.Random) -> np.ndarray:
        """0 or 1 for each document: a flight at the chance of all; where that lands too far from
        the nearest size to be had, a walk back through the sums that lead to that size."""
        amount = chance * (self.size.sum() + self.rest)
        want, near = self.nearest(amount), NEAR / 2 * amount
        p = settle(land(flight(np.full(len(self.size), chance), self.size, rng), self.size, rng), self.size, want, near)
        if abs((p * self.size).sum() - want) <= max(near, self.unit * len(p) if self.unit > 1 else 0) or len(p) * sum(self.steps) > 2**28:
            return p
        want = rng.choice(self.sums[np.abs(self.sums - want) <= near].tolist())
        order, layers, left = rng.sample(range(len(p)), len(p)), [1], round(want / self.unit)
        for i in order:
            layers.append(layers[-1] | layers[-1] << self.steps[i])
        for i, before in zip(reversed(order), reversed(layers[:-1]), strict=True):
            x = self.steps[i]
            take, skip = left >= x and before >> (left - x) & 1, before >> left & 1
            p[i] = float(take and (not skip or rng.random() < chance))
            left -= x * int(p[i])
        return p


#: Documents of a source that are drawn one by one at most.
HAND = 2000
#: Part of its share by which a source may be off before the whole set is made smaller.
NEAR = 0.01


def fit_total(targets: list[tuple[str, float, int]], stock: dict[str, tuple[int, int]], hands: dict[str, Hand], total: float | None = None) -> list[Share]:
    """The plan of the largest total at which every source can be drawn to within ``NEAR`` of its
    share; where there is none, of the total at which the worst source is least off."""
    first = plan_shares(targets, stock, total)
    asked = {s.source: (s.base + s.chance) * s.tokens for s in first if s.base + s.chance > 0}
    size = sum(asked.values())
    whole = {k * stock[s][1] * size / asked[s] for s in asked for k in range(1, 1 + min(1000, math.floor(asked[s] / stock[s][1] + _EPS)))}

    def off(at: float) -> float:
        worst = 0.0
        for s, amount in asked.items():
            due, tokens = amount * at / size, stock[s][1]
            copies = math.floor(due / tokens + _EPS)
            worst = max(worst, hands[s].miss(max(0.0, due - copies * tokens)) / due) if s in hands else worst
        return worst

    best, least = size, math.inf
    for at in sorted({size * (1 - k / 1000) for k in range(1000)} | {t for t in whole if t <= size}, reverse=True):
        if (now := off(at)) < least - _EPS:
            best, least = at, now
        if least <= NEAR:
            break
    return first if best == size else plan_shares(targets, stock, best)


def reserve_of(n: int) -> int:
    """Documents of a group that wait for the last flight, to make up for large open ones."""
    return min(n, 500, n // 10 + 60)


def _flier(last: bool, seed: int):
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", "doc_id"], kind="stable").drop(columns=["_block", "_order"])
        size, p = pdf["tokens"].to_numpy(float), pdf["chance"].to_numpy().copy()
        rng = random.Random(int(pdf["doc_id"].iloc[0]) * 31 + len(pdf) + seed)
        main = len(p) - reserve_of(len(p))
        p[:main] = flight(p[:main], size[:main], rng)
        if last:
            p = land(p, size, rng)
        return pdf.assign(chance=p)

    return fly


def mix_sources(docs: DataFrame, targets: DataFrame, total: float | None = None, block: int = 20_000, seed: int = 17) -> tuple[DataFrame, list[Share]]:
    """``(doc_id, source, tokens, copies)`` of the set, and the plan it follows.

    ``docs(doc_id, source, tokens)`` with clean sources, every id once; ``targets(source,
    target_share, max_repeats)``, one row per source, a parameter of the mix.  Documents of
    null or untargeted sources are not in the set; empty ones (0 tokens) weigh nothing and are
    drawn like others; an empty input gives an empty set.  The same seed gives the same set.

    Plan: one aggregation gives each source's stock.  Small sources, and the heaviest documents
    of the others, are drawn on the driver (``Hand``), and the total is such that every source
    can have its share (``fit_total``).  The other documents make up what the heavy ones leave
    of their source's amount, with one chance for all.  Flights run in blocks of about ``block``
    documents per source, so a source of any size is spread over tasks; each block leaves a
    reserve of at most 500 and two open units, which fly again together, level by level,
    until one group per source is left and lands.
    """
    wanted = [(r[0], float(r[1] or 0), int(r[2] or 0)) for r in targets.select("source", "target_share", "max_repeats").collect() if r[0]]
    docs = cut(docs.select("doc_id", "source", F.col("tokens").cast("long").alias("tokens")).where(F.col("source").isin([s for s, _, _ in wanted])))
    stock = {r["source"]: (r["docs"], r["tokens"] or 0) for r in docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")).collect()}
    if not wanted:
        return docs.withColumn("copies", F.lit(0)).where("false"), []

    def by(values: dict[str, float]) -> Column:
        return F.element_at(F.create_map(*(x for s, v in values.items() for x in (F.lit(s), F.lit(v)))), F.col("source"))

    # At most HAND rows a source: all of a small one, or fewer than HAND of more than 1/HAND of its tokens.
    alone = by({s: -1.0 if stock.get(s, (0, 0))[0] <= HAND else stock[s][1] / HAND for s, _, _ in wanted})
    held: dict[str, list] = {}
    for r in docs.where(F.col("tokens") > alone).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").collect():
        held.setdefault(r["source"], []).append(r)
    hands = {s: Hand([r["tokens"] for r in rows], stock[s][1] - sum(r["tokens"] for r in rows)) for s, rows in held.items()}
    plan = fit_total(wanted, stock, hands, total)
    rates = {s.source: s for s in plan}
    even, drawn = {s.source: s.chance for s in plan}, []
    for s, hand in hands.items():
        p = hand.draw(rates[s].chance, random.Random(f"{seed} {s}")) if rates[s].chance > 0 else np.zeros(len(hand.size))
        drawn += [(r["doc_id"], float(x)) for r, x in zip(held[s], p, strict=True)]
        if hand.rest:
            even[s] = min(1.0, max(0.0, (rates[s].chance * rates[s].tokens - float((p * hand.size).sum())) / hand.rest))
    # Where only some hundreds are to be drawn of many, the flight would leave too few to land exactly: about HAND
    # documents a source, the same chance for each, are drawn by hash, and the set from them.
    scarce = {s: even[s] for s in even if rates[s].docs > HAND and 0 < even[s] * rates[s].docs < HAND / 4}
    if scarce:
        pool: dict[str, list] = {}
        lot = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), by({s: rates[s].docs for s in scarce}))
        for r in docs.where(F.col("source").isin(list(scarce)) & (lot < HAND) & (F.col("tokens") <= alone)).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").collect():
            pool.setdefault(r["source"], []).append(r)
        for s, rows in pool.items():
            hand = Hand([r["tokens"] for r in rows], 0)
            rest = hands[s].rest if s in hands else rates[s].tokens
            p = hand.draw(min(1.0, scarce[s] * rest / max(1.0, hand.size.sum())), random.Random(f"{seed} {s} pool"))
            drawn += [(r["doc_id"], float(x)) for r, x in zip(rows, p, strict=True)]
            even[s] = 0.0
    picks = docs.sparkSession.createDataFrame(drawn, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _picked double")
    state = docs.join(F.broadcast(picks), "doc_id", "left").withColumn("chance", F.coalesce("_picked", by(even))).drop("_picked")  # the hands
    blocks = {s: max(1, -(-rates[s].docs // block)) for s in rates}
    decided: list[DataFrame] = []
    schema = state.schema.simpleString()[7:-1].replace(":", " ")
    while True:
        last = all(b == 1 for b in blocks.values())
        counts = F.element_at(F.create_map(*(x for s, b in blocks.items() for x in (F.lit(s), F.lit(b)))), F.col("source"))

        order = F.xxhash64("doc_id", F.lit(seed))
        flown = state.withColumn("_order", order).withColumn("_block", F.pmod(F.xxhash64("_order"), counts).cast("int"))
        flown = cut(flown.groupBy("source", "_block").applyInPandas(_flier(last, seed), schema))
        if last:
            decided.append(flown)
            break
        is_open = (F.col("chance") > 0) & (F.col("chance") < 1)
        decided.append(flown.where(~is_open))
        state = flown.where(is_open)
        blocks = {s: max(1, -(-b * (reserve_of(block) + 2) // block)) if b > 1 else 1 for s, b in blocks.items()}
    whole = decided[0]
    for more in decided[1:]:
        whole = whole.unionByName(more)
    copies = (by({s.source: s.base for s in plan}) + F.round("chance").cast("int")).cast("int")
    return whole.withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "tokens", "copies"), plan


def reached_shares(mixed: DataFrame, plan: list[Share]) -> DataFrame:
    """Per target: what was asked and what the set really holds (0 where nothing was to be had)."""
    spark = mixed.sparkSession
    asked = spark.createDataFrame([(s.source, s.target_share, s.max_repeats, s.docs, s.tokens) for s in plan], "source string, target_share double, max_repeats int, docs_on_file bigint, tokens_on_file bigint")
    got = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_repeats"))
    whole = mixed.agg(F.sum(F.col("tokens") * F.col("copies")).alias("all_tokens"))
    zero = {c: 0 for c in ("docs", "copies", "tokens", "most_repeats")}
    return (
        asked.join(got, "source", "left").fillna(zero).join(F.broadcast(whole))  # one row
        .withColumn("actual_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)))
        .drop("all_tokens")
    )
