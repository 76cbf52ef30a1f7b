"""Roll-ups, budgets and call sequences of agent traces."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def array_sum(items: Column, field: str, kind: str = "double") -> Column:
    """Sum of a field over an array of structs; null arrays, elements and values count 0."""
    values = F.transform(F.coalesce(items, F.array()), lambda x: F.coalesce(x[field].cast(kind), F.lit(0).cast(kind)))
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)


def trace_rollup(df: DataFrame, laps: str) -> DataFrame:
    """Per-trace totals of its laps: calls, tokens, working and waiting time, tokens sent again
    (all laps but the first), and the tools used in order of first use."""
    x = F.col(laps)
    tools = F.flatten(F.transform(F.filter(x, lambda p: p.isNotNull()), lambda p: F.coalesce(p["tools"], F.array())))
    names = F.transform(F.filter(tools, lambda t: t.isNotNull() & t["tool"].isNotNull()), lambda t: t["tool"])
    again = F.when(F.size(x) > 1, array_sum(F.slice(x, 2, F.greatest(F.size(x), F.lit(1))), "prompt_tokens", "bigint")).otherwise(0)
    return df.withColumns(
        {
            "n_laps": F.coalesce(F.nullif(F.size(x), F.lit(-1)), F.lit(0)),
            "lap_prompt": array_sum(x, "prompt_tokens", "bigint"),
            "lap_completion": array_sum(x, "completion_tokens", "bigint"),
            "active_s": F.round(array_sum(x, "call_s"), 6),
            "waited_s": F.round(array_sum(x, "wait_s"), 6),
            "sent_again": again,
            "tool_order": F.coalesce(F.array_distinct(names), F.array().cast("array<string>")),
        }
    )


class Limit(NamedTuple):
    """A budget of a trace: what an item costs, the most of it, and what must be left for one more."""

    name: str
    cost: Callable[[Column], Column]
    most: float
    reserve: float = 0.0


def running_budget(df: DataFrame, key: str, items: str, limits: Sequence[Limit]) -> DataFrame:
    """``(key, pos, limit)``: the first item before which a budget was spent, and the first such
    budget in the order given; traces that never spend one give no row.

    A budget is spent when its running total has reached ``most`` or leaves less than
    ``reserve``.  Null items and costs count 0.  The fold stays inside the row's own array:
    no explosion, no shuffle.
    """
    zero = F.struct(F.lit(0).alias("pos"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("limit"), *(F.lit(0.0).alias(f"t{i}") for i in range(len(limits))))

    def add(acc: Column, x: Column) -> Column:
        fired = F.lit(None).cast("string")
        for i, x_limit in reversed(list(enumerate(limits))):
            spent = (acc[f"t{i}"] >= x_limit.most) | (x_limit.most - acc[f"t{i}"] < x_limit.reserve)
            fired = F.when(spent, x_limit.name).otherwise(fired)
        now = acc["limit"].isNull() & fired.isNotNull()
        totals = ((acc[f"t{i}"] + F.coalesce(b.cost(x).cast("double"), F.lit(0.0))).alias(f"t{i}") for i, b in enumerate(limits))
        return F.struct((acc["pos"] + 1).alias("pos"), F.when(now, acc["pos"]).otherwise(acc["at"]).alias("at"), F.coalesce(acc["limit"], fired).alias("limit"), *totals)

    end = F.aggregate(F.col(items), zero, add)
    return df.select(key, end.alias("_b")).where("_b.limit IS NOT NULL").select(key, F.col("_b.at").alias("pos"), "_b.limit")


def order_violations(df: DataFrame, key: str, path: str, needs: Mapping[str, str]) -> DataFrame:
    """``(key, pos, tool, missing)``: calls before which the call they need had not been made.

    ``path`` is an ordered array of call names; repeated and null names are allowed.
    """
    need = F.create_map(*(F.lit(x) for kv in needs.items() for x in kv))
    flat = df.select(key, path, F.posexplode(path).alias("pos", "tool")).withColumn("missing", F.element_at(need, F.col("tool")))
    seen = F.array_contains(F.slice(path, F.lit(1), F.col("pos")), F.col("missing"))
    return flat.where(F.col("missing").isNotNull() & ~F.coalesce(seen, F.lit(False))).select(key, "pos", "tool", "missing")


def sequence_accepted(path: Column, pattern: str) -> Column:
    """Whether the whole call sequence, joined by blanks, matches a regular expression of names."""
    return F.array_join(F.coalesce(path, F.array().cast("array<string>")), " ", "?").rlike(f"^(?:{pattern})$")


def stage_shares(df: DataFrame, by: Sequence[str], stages: Mapping[str, Column]) -> DataFrame:
    """``(*by, stage, total, share)`` of several cost columns, in one aggregation."""
    aggs = [F.sum(c).alias(f"s{i}") for i, c in enumerate(stages.values())]
    whole = sum((F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(len(stages))), F.lit(0.0))
    entries = F.array(*(F.struct(F.lit(k).alias("stage"), F.col(f"s{i}").alias("total")) for i, k in enumerate(stages)))
    return (
        df.groupBy(*by).agg(*aggs).withColumn("whole", whole).select(*by, "whole", F.explode(entries).alias("e"))
        .select(*by, "e.stage", F.round("e.total", 6).alias("total"), F.round(F.try_divide(F.col("e.total"), F.col("whole")), 6).alias("share"))
    )


def arm_summary(df: DataFrame, arm: str, passed: Column) -> DataFrame:
    """Count, passes, token sums and cost of each arm; NaN costs count as missing."""
    cost = F.when(~F.isnan("cost_usd"), F.col("cost_usd"))
    return df.groupBy(arm).agg(
        F.count("*").alias("n"), F.count_if(passed).alias("passed"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum(cost), 6).alias("cost"), F.round(F.avg(cost), 8).alias("mean_cost"),
    )


def capacity(df: DataFrame, ts: Column, tokens: str, limits: Mapping[str, float]) -> DataFrame:
    """One row: requests, window, tokens a minute and a day, and per daily limit the ratio and the
    multiple of this traffic at which it breaks."""
    seen = df.select(ts.alias("t"), F.col(tokens).alias("k"))
    minutes = (F.unix_micros(F.max("t")) - F.unix_micros(F.min("t"))) / 60e6
    one = seen.agg(F.count("*").alias("requests"), F.sum("k").alias("tokens"), F.round(minutes, 4).alias("minutes"), F.round(F.try_divide(F.sum("k"), minutes), 4).alias("tokens_per_minute"))
    for name, most in limits.items():
        one = one.withColumns({f"{name}_ratio": F.round(F.col("tokens") / most, 6), f"{name}_breaks_at": F.round(F.try_divide(F.lit(most), F.col("tokens")), 6)})
    return one


def scale_to_total(parts: Sequence[Column], total: Column) -> list[Column]:
    """Parts scaled to a known total; what rounding leaves goes to the first."""
    whole = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))
    scaled = [F.coalesce(F.round(F.try_divide(F.coalesce(p, F.lit(0)) * total, whole)), F.lit(0.0)).cast("long") for p in parts]
    rest = total - sum(scaled, F.lit(0))
    return [scaled[0] + rest, *scaled[1:]]


def unseen_values(df: DataFrame, key: str, items: str, used: Column, produced: Column) -> DataFrame:
    """``(key, pos, value)``: values that an item uses although no earlier item of its trace had
    produced them.  ``used`` and ``produced`` are arrays over the element ``x``."""
    flat = df.select(key, F.posexplode(items).alias("pos", "x")).select(key, "pos", F.coalesce(used, F.array().cast("array<string>")).alias("u"), F.coalesce(produced, F.array().cast("array<string>")).alias("p"))
    first = flat.select(key, "pos", F.explode("p").alias("value")).groupBy(key, "value").agg(F.min("pos").alias("since"))
    asked = flat.select(key, "pos", F.explode("u").alias("value")).distinct()
    return asked.join(first, [key, "value"], "left").where(F.col("since").isNull() | (F.col("since") >= F.col("pos"))).select(key, "pos", "value")


def budget_left(df: DataFrame, key: str, items: str, value: Column, most: float, cap: float) -> DataFrame:
    """``(key, pos, left)``: what each item may use at most: the budget less what earlier items
    used, not under zero and not over ``cap``."""
    flat = df.select(key, F.posexplode(items).alias("pos", "x"))
    over = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.coalesce(value, F.lit(0))).over(over), F.lit(0))
    return flat.select(key, "pos", F.least(F.lit(cap), F.greatest(F.lit(0), F.lit(most) - spent)).cast("double").alias("left"))
