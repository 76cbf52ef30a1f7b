"""Log slices, statistics, graded runs and trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import rates, traces
from tidemark.operators.ranks import LOWER_MIDDLE, UPPER_MIDDLE, iqr_outliers, nearest_rank, order_statistics, rounded_index
from tidemark.operators.relations import hash_sample, latest_per_key, ranked, stratified_sample
from tidemark.plans.registry import Registry
from tidemark.sources.tables import table

REGISTRY = Registry()
Q = REGISTRY.add

# Tables hold copies of records: every query counts a record once.


def attempts(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "suite_v2_attempt").select("id", *cols).dropDuplicates(["id"])


def races(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "race_single").select("run_id", *cols).dropDuplicates(["run_id"])


def evals(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "eval_before").select("trace_id", *cols).dropDuplicates(["trace_id"])


def demos(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "demo").select("trace_id", *cols).dropDuplicates(["trace_id"])


def trajectories(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "traj_before").select("claim_id", *cols).dropDuplicates(["claim_id"])


def once(name: str, key: str, cols: str) -> str:
    """One row per key; copies are equal, so any will do."""
    return f"(SELECT {key}, {', '.join(f'any_value({c.strip()}) AS {c.strip()}' if c.strip() not in _NULLABLE else f'first({c.strip()}) AS {c.strip()}' for c in cols.split(','))} FROM {name} GROUP BY {key})"


_NULLABLE = set("arm cost_usd latency_s laps stop_reason checks judge assessment citations question raw_output refused_by error tool_calls output grounds".split())
ATT = lambda cols: once("suite_v2_attempt", "id", cols)
RACE = lambda cols: once("race_single", "run_id", cols)
EVAL = lambda cols: once("eval_before", "trace_id", cols)
DEMO = lambda cols: once("demo", "trace_id", cols)
TRAJ = lambda cols: once("traj_before", "claim_id", cols)

# ---- log slices ---------------------------------------------------------------------------


@Q("slice_counts", " UNION ALL ".join(
    f"SELECT '{name}' AS slice, coalesce(nullif({sql}, ''), '-') AS value, count(*) AS n FROM {ATT('source, prompt_version, position, ts')} GROUP BY ALL"
    for name, sql in (("source", "source"), ("prompt_version", "prompt_version"), ("position", '"position"'), ("hour", "substr(ts, 12, 2) || ':00'"))
).replace("any_value(position) AS position", 'any_value("position") AS "position"'))
def slice_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = attempts(spark, d, "source", "prompt_version", "position", "ts")
    hour = F.concat(F.substring("ts", 12, 2), F.lit(":00"))
    return rates.slice_counts(rows, {"source": F.col("source"), "prompt_version": F.col("prompt_version"), "position": F.col("position"), "hour": hour})


@Q("hour_bucket", f"SELECT substr(ts, 12, 2) || ':00' AS hour, count(*) AS n FROM {ATT('ts')} GROUP BY 1")
def hour_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Hours of the local wall clock, as written, not of UTC."""
    return attempts(spark, d, "ts").groupBy(F.concat(F.substring("ts", 12, 2), F.lit(":00")).alias("hour")).agg(F.count("*").alias("n"))


@Q("day_overview", f"SELECT substr(ts, 1, 10) AS day, count(*) AS n, count(DISTINCT prompt_version) AS versions FROM {ATT('ts, prompt_version')} GROUP BY 1")
def day_overview(spark: SparkSession, d: str) -> DataFrame:
    return attempts(spark, d, "ts", "prompt_version").groupBy(F.substring("ts", 1, 10).alias("day")).agg(F.count("*").alias("n"), F.countDistinct("prompt_version").alias("versions"))


@Q("latest_day", f"SELECT id, ts FROM {ATT('ts')} WHERE substr(ts, 1, 10) = (SELECT max(substr(ts, 1, 10)) FROM suite_v2_attempt)")
def latest_day(spark: SparkSession, d: str) -> DataFrame:
    rows = attempts(spark, d, "ts").withColumn("day", F.substring("ts", 1, 10))
    last = table(spark, d, "suite_v2_attempt").agg(F.max(F.substring("ts", 1, 10)).alias("day"))
    return rows.join(F.broadcast(last), "day").select("id", "ts")  # one row


@Q("time_window", f"SELECT id, ts FROM {ATT('ts')} WHERE substr(ts, 12, 5) BETWEEN '09:00' AND '17:30'")
def time_window(spark: SparkSession, d: str) -> DataFrame:
    return attempts(spark, d, "ts").where(F.substring("ts", 12, 5).between("09:00", "17:30"))


@Q("text_filter", f"SELECT id FROM {ATT('reason, summary')} WHERE contains(lower(coalesce(reason, '')), 'deductible') OR contains(lower(coalesce(summary, '')), 'deductible')")
def text_filter(spark: SparkSession, d: str) -> DataFrame:
    holds = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains("deductible")
    return attempts(spark, d, "reason", "summary").where(holds("reason") | holds("summary")).select("id")


@Q("filter_chain", f"SELECT id, tokens FROM {ATT('source, tag, \"position\", tokens').replace('any_value(\"position\") AS \"position\"', 'any_value(\"position\") AS pos')} WHERE upper(coalesce(pos, '')) = 'DENIED' AND source IN ('production', 'case-file') AND tokens >= 2000")
def filter_chain(spark: SparkSession, d: str) -> DataFrame:
    rows = attempts(spark, d, "source", "tag", "position", "tokens")
    tests = [F.upper(F.coalesce("position", F.lit(""))) == "DENIED", F.col("source").isin("production", "case-file"), F.col("tokens") >= 2000]
    for test in tests:
        rows = rows.where(test)
    return rows.select("id", "tokens")


# ---- statistics ---------------------------------------------------------------------------

_RANKED = f"(SELECT arm, latency_s AS v, row_number() OVER (PARTITION BY arm ORDER BY latency_s) AS i, count(*) OVER (PARTITION BY arm) AS n FROM {RACE('arm, latency_s')} WHERE latency_s IS NOT NULL AND NOT isnan(latency_s))"


@Q("nearest_rank", f"SELECT arm, n, max(v) FILTER (i = greatest(ceil(50 * n / 100.0), 1)) AS p50, max(v) FILTER (i = greatest(ceil(99 * n / 100.0), 1)) AS p99 FROM {_RANKED} GROUP BY arm, n")
def nearest_rank_latency(spark: SparkSession, d: str) -> DataFrame:
    return order_statistics(races(spark, d, "arm", "latency_s"), ["arm"], "latency_s", {"p50": nearest_rank(50), "p99": nearest_rank(99)})


@Q("median_latency", f"SELECT arm, n, round(median(v), 9) AS median FROM {_RANKED} GROUP BY arm, n")
def median_latency(spark: SparkSession, d: str) -> DataFrame:
    both = order_statistics(races(spark, d, "arm", "latency_s"), ["arm"], "latency_s", {"lo": LOWER_MIDDLE, "hi": UPPER_MIDDLE})
    return both.select("arm", "n", F.round((F.col("lo") + F.col("hi")) / 2, 9).alias("median"))


@Q("quartile_index", f"SELECT arm, n, " + ", ".join(f"max(v) FILTER (i - 1 = floor({p} * (n - 1) + 0.5)) AS {name}" for name, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))) + f" FROM {_RANKED} GROUP BY arm, n")
def quartile_index(spark: SparkSession, d: str) -> DataFrame:
    return order_statistics(races(spark, d, "arm", "latency_s"), ["arm"], "latency_s", {"q1": rounded_index(0.25), "q2": rounded_index(0.5), "q3": rounded_index(0.75)})


_COSTS = f"(SELECT run_id, arm, cost_usd FROM {RACE('arm, cost_usd')} WHERE cost_usd IS NOT NULL AND NOT isnan(cost_usd))"


@Q("cost_outliers", f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY cost_usd) - 1 AS i, count(*) OVER (PARTITION BY arm) AS n FROM {_COSTS}),
f AS (SELECT arm, max(cost_usd) FILTER (i = floor(0.25 * (n - 1) + 0.5)) AS q1, max(cost_usd) FILTER (i = floor(0.75 * (n - 1) + 0.5)) AS q3 FROM c GROUP BY arm),
o AS (SELECT c.run_id, c.arm, cost_usd, CASE WHEN cost_usd < q1 - 1.5 * (q3 - q1) THEN 'low' WHEN cost_usd > q3 + 1.5 * (q3 - q1) THEN 'high' END AS side
      FROM c JOIN f ON c.arm IS NOT DISTINCT FROM f.arm),
calm AS (SELECT arm FROM o GROUP BY arm HAVING count(side) = 0),
e AS (SELECT c.* FROM c JOIN calm ON c.arm IS NOT DISTINCT FROM calm.arm)
SELECT * FROM o WHERE side IS NOT NULL
UNION ALL SELECT run_id, arm, cost_usd, 'lowest' FROM e QUALIFY row_number() OVER (PARTITION BY arm ORDER BY cost_usd, arm, run_id) <= 3
UNION ALL SELECT run_id, arm, cost_usd, 'highest' FROM e QUALIFY row_number() OVER (PARTITION BY arm ORDER BY cost_usd DESC, arm, run_id) <= 3""")  # fmt: skip
def cost_outliers(spark: SparkSession, d: str) -> DataFrame:
    return iqr_outliers(races(spark, d, "arm", "cost_usd"), ["arm"], "cost_usd").select("run_id", "arm", "cost_usd", "side")


_ARM = "count(*) AS n, count(*) FILTER (stop_reason IS NULL) AS passed, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(cost_usd) FILTER (NOT isnan(cost_usd)), 6) AS cost, round(avg(cost_usd) FILTER (NOT isnan(cost_usd)), 8) AS mean_cost"


@Q("arm_summary", f"SELECT arm, {_ARM} FROM {RACE('arm, stop_reason, prompt_tokens, completion_tokens, cost_usd')} GROUP BY arm")
def arm_summary(spark: SparkSession, d: str) -> DataFrame:
    return traces.arm_summary(races(spark, d, "arm", "stop_reason", "prompt_tokens", "completion_tokens", "cost_usd"), "arm", F.col("stop_reason").isNull())


@Q("share_of_total", f"SELECT arm, total, round(total / sum(total) OVER (), 6) AS share, row_number() OVER (ORDER BY total DESC, arm) AS place FROM (SELECT arm, CAST(sum(tokens) AS BIGINT) AS total FROM {RACE('arm, tokens')} GROUP BY arm)")
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    return rates.share_of_total(races(spark, d, "arm", "tokens"), "arm", "tokens").withColumn("place", F.col("place").cast("long"))


@Q("token_multiplier", f"SELECT round(avg(tokens) FILTER (arm = 'squad') / avg(tokens) FILTER (arm = 'single'), 6) AS multiplier FROM {RACE('arm, tokens')}")
def token_multiplier(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda a: F.avg(F.when(F.col("arm") == a, F.col("tokens")))
    return races(spark, d, "arm", "tokens").agg(F.round(mean("squad") / mean("single"), 6).alias("multiplier"))


@Q("case_grid", f"""
SELECT id, {', '.join(f"min(tokens) FILTER (arm = '{a}') AS {a}" for a in ('single', 'squad', 'workflow', 'relay', 'critic', 'replay'))}
FROM {RACE('id, arm, tokens')} GROUP BY id""")  # fmt: skip
def case_grid(spark: SparkSession, d: str) -> DataFrame:
    """Cases by arms: the fewest tokens of each."""
    return races(spark, d, "id", "arm", "tokens").groupBy("id").pivot("arm", ["single", "squad", "workflow", "relay", "critic", "replay"]).agg(F.min("tokens"))


# ---- graded runs --------------------------------------------------------------------------


@Q("pass_rates", f"""
SELECT CASE WHEN grouping(mode) = 1 THEN 'ALL' ELSE mode END AS mode, CAST(grouping(mode) AS INTEGER) AS level, count(*) AS n, count(*) FILTER (ok) AS passed, round(100.0 * count(*) FILTER (ok) / count(*), 4) AS pct
FROM (SELECT trace_id, any_value(mode) AS mode, any_value(pass) AS ok FROM eval_before GROUP BY trace_id) GROUP BY ROLLUP (mode)""")  # fmt: skip
def pass_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates.pass_rates(evals(spark, d, "mode", "pass"), "mode", "pass")


@Q("check_matrix", f"SELECT mode, c.name AS name, count(*) AS n, count(*) FILTER (NOT c.passed) AS failed FROM (SELECT mode, unnest(checks) AS c FROM {EVAL('mode, checks')}) WHERE c.name IS NOT NULL GROUP BY ALL")
def check_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rates.check_matrix(evals(spark, d, "mode", "checks"), "mode", "checks")


_AGREE = """count(*) AS n, count(*) FILTER (a = b) AS agree, count(*) FILTER (a = 'PASS' AND b != 'PASS') AS label_only, count(*) FILTER (a != 'PASS' AND b = 'PASS') AS verdict_only,
count(*) FILTER (b IS NULL) AS unparsed, round(100.0 * count(*) FILTER (a = b) / count(*), 4) AS pct,
round((avg(CAST(a = b AS INT)) FILTER (b IS NOT NULL) - pe) / nullif(1 - pe, 0), 6) AS kappa"""


def _agree_sql(by: str) -> str:
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    link = f" ON e.{by} = p.{by}" if by else " ON true"
    base = f"(SELECT {keys}reference_label AS a, judge AS b FROM {EVAL('mode, reference_label, judge')} WHERE reference_label IS NOT NULL)"
    chance = f"(SELECT {keys}pa * pb + (1 - pa) * (1 - pb) AS pe FROM (SELECT {keys}avg(CAST(a = 'PASS' AS INT)) AS pa, avg(CAST(b = 'PASS' AS INT)) AS pb FROM {base} WHERE b IS NOT NULL{group}))"
    return f"SELECT {'e.' + keys if by else ''}{_AGREE} FROM {base} e JOIN {chance} p{link} GROUP BY {'e.' + keys if by else ''}pe"


@Q("kappa", _agree_sql(""))
def kappa(spark: SparkSession, d: str) -> DataFrame:
    return rates.agreement(evals(spark, d, "reference_label", "judge"), [], "reference_label", "judge", "PASS")


@Q("agreement_by_mode", _agree_sql("mode"))
def agreement_by_mode(spark: SparkSession, d: str) -> DataFrame:
    return rates.agreement(evals(spark, d, "mode", "reference_label", "judge"), ["mode"], "reference_label", "judge", "PASS")


@Q("verdict_counts", f"SELECT judge, count(*) AS n FROM {EVAL('judge')} GROUP BY judge")
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return evals(spark, d, "judge").groupBy("judge").agg(F.count("*").alias("n"))


REASONS = ("position", "payable", "citation", "error")


@Q("mode_zero_fill", "SELECT label, count(*) FILTER (list_contains(r, label)) AS n, round(100.0 * count(*) FILTER (list_contains(r, label)) / count(*), 4) AS pct FROM (SELECT claim_id, any_value(outcome_fail_reasons) AS r FROM traj_before GROUP BY claim_id), (SELECT unnest(['position', 'payable', 'citation', 'error']) AS label) GROUP BY label")
def mode_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    return rates.label_counts(trajectories(spark, d, "outcome_fail_reasons"), F.col("outcome_fail_reasons"), REASONS)


@Q("taxonomy", f"""
WITH e AS (SELECT *, len(list_filter(checks, lambda c: c.name IS NULL)) AS odd FROM {EVAL('assessment, judge, latency_s, rate_limit_wait_s, checks')})
SELECT name, count(*) FILTER (hit) AS n, round(100.0 * count(*) FILTER (hit) / count(*), 4) AS pct, min(trace_id) FILTER (hit) AS example FROM (
  SELECT trace_id, 'no assessment' AS name, assessment IS NULL AS hit FROM e UNION ALL SELECT trace_id, 'judge failed', coalesce(judge = 'FAIL', false) FROM e
  UNION ALL SELECT trace_id, 'slow', coalesce(latency_s > 20, false) FROM e UNION ALL SELECT trace_id, 'waited', coalesce(rate_limit_wait_s > 0, false) FROM e
  UNION ALL SELECT trace_id, 'unnamed check', coalesce(odd > 0, false) FROM e) GROUP BY name""")  # fmt: skip
def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    rows = evals(spark, d, "assessment", "judge", "latency_s", "rate_limit_wait_s", "checks")
    unnamed = F.exists("checks", lambda c: c["name"].isNull())
    tests = {"no assessment": F.col("assessment").isNull(), "judge failed": F.col("judge") == "FAIL", "slow": F.col("latency_s") > 20, "waited": F.col("rate_limit_wait_s") > 0, "unnamed check": unnamed}
    return rates.taxonomy(rows, tests, "trace_id")


_BEST = "(SELECT id, bool_or(stop_reason IS NULL) AS ok FROM {0} WHERE arm = '{1}' GROUP BY id)"


@Q("fixed_broken", f"SELECT a.id, CASE WHEN b.ok THEN 'fixed' ELSE 'broken' END AS change FROM {_BEST.format(RACE('id, arm, stop_reason'), 'single')} a JOIN {_BEST.format(RACE('id, arm, stop_reason'), 'squad')} b ON a.id = b.id WHERE a.ok != b.ok")
def fixed_broken(spark: SparkSession, d: str) -> DataFrame:
    rows = races(spark, d, "id", "arm", "stop_reason")
    best = lambda arm: rows.where(F.col("arm") == arm).groupBy("id").agg(F.bool_or(F.col("stop_reason").isNull()).alias("ok"))
    return rates.flips(best("single"), best("squad"), "id", "ok")


@Q("mode_deltas", f"""
WITH c AS (SELECT mode, arm, CAST(count(*) AS DOUBLE) AS n FROM {RACE('mode, arm, stop_reason')} WHERE stop_reason IS NOT NULL GROUP BY ALL)
SELECT mode, before, after, CASE WHEN after > before THEN 'up' WHEN after < before THEN 'down' ELSE 'same' END AS change FROM (
SELECT coalesce(a.mode, b.mode) AS mode, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM (FROM c WHERE arm = 'single') a FULL JOIN (FROM c WHERE arm = 'squad') b ON a.mode = b.mode)""")  # fmt: skip
def mode_deltas(spark: SparkSession, d: str) -> DataFrame:
    stops = races(spark, d, "mode", "arm", "stop_reason").where("stop_reason IS NOT NULL").groupBy("mode", "arm").agg(F.count("*").cast("double").alias("n"))
    return rates.deltas(stops.where("arm = 'single'"), stops.where("arm = 'squad'"), "mode", "n")


@Q("uniform_fingerprint", f"SELECT arm, count(DISTINCT cases_sha) AS shas, count(DISTINCT cases_sha) = 1 AS uniform FROM {RACE('arm, cases_sha')} GROUP BY arm")
def uniform_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return races(spark, d, "arm", "cases_sha").groupBy("arm").agg(F.countDistinct("cases_sha").alias("shas")).withColumn("uniform", F.col("shas") == 1)


@Q("fraction_text", "SELECT mode, count(*) FILTER (ok) || '/' || count(*) || ' ' || CAST(round(100.0 * count(*) FILTER (ok) / count(*)) AS BIGINT) || '%' AS passed FROM (SELECT trace_id, any_value(mode) AS mode, any_value(pass) AS ok FROM eval_before GROUP BY trace_id) GROUP BY mode")
def fraction_text(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.text import rounded_fraction

    return evals(spark, d, "mode", "pass").groupBy("mode").agg(F.count_if("pass").alias("k"), F.count("*").alias("n")).select("mode", rounded_fraction(F.col("k"), F.col("n")).alias("passed"))


@Q("wrong_edition_rate", f"SELECT tag, count(*) AS n, count(*) FILTER (bad) AS wrong, round(count(*) FILTER (bad) / count(*), 6) AS rate FROM (SELECT tag, coalesce(len(list_filter(checks, lambda c: c.name = 'edition' AND NOT c.passed)) > 0, false) AS bad FROM {EVAL('tag, checks')}) GROUP BY tag")
def wrong_edition_rate(spark: SparkSession, d: str) -> DataFrame:
    bad = F.coalesce(F.exists("checks", lambda c: F.coalesce((c["name"] == "edition") & ~c["passed"], F.lit(False))), F.lit(False))
    return evals(spark, d, "tag", "checks").groupBy("tag").agg(F.count("*").alias("n"), F.count_if(bad).alias("wrong")).withColumn("rate", F.round(F.col("wrong") / F.col("n"), 6))


# ---- traces -------------------------------------------------------------------------------

_LAPS = "unnest(range(1, coalesce(len(laps), 0) + 1)) AS i"


@Q("trace_rollup", f"""
WITH r AS {RACE('laps')}, f AS (SELECT run_id, list_filter(coalesce(laps, []), lambda x: x IS NOT NULL) AS l, coalesce(len(laps), 0) AS n_laps, laps FROM r)
SELECT run_id, CAST(n_laps AS INTEGER) AS n_laps, CAST(coalesce(list_sum(list_transform(l, lambda x: x.prompt_tokens)), 0) AS BIGINT) AS lap_prompt, CAST(coalesce(list_sum(list_transform(l, lambda x: x.completion_tokens)), 0) AS BIGINT) AS lap_completion,
  round(coalesce(list_sum(list_transform(l, lambda x: x.call_s)), 0), 6) AS active_s, round(coalesce(list_sum(list_transform(l, lambda x: x.wait_s)), 0), 6) AS waited_s,
  CAST(coalesce(list_sum(list_transform(list_filter(laps[2:], lambda x: x IS NOT NULL), lambda x: x.prompt_tokens)), 0) AS BIGINT) AS sent_again,
  coalesce((SELECT string_agg(tool, ' ' ORDER BY k) FROM (SELECT tool, min(k) AS k FROM (SELECT t.tool AS tool, k FROM (SELECT unnest(ts) AS t, unnest(range(len(ts))) AS k FROM (SELECT flatten(list_transform(f.l, lambda x: coalesce(x.tools, []))) AS ts))) WHERE tool IS NOT NULL GROUP BY tool)), '') AS tool_order
FROM f""")  # fmt: skip
def trace_rollup(spark: SparkSession, d: str) -> DataFrame:
    found = traces.trace_rollup(races(spark, d, "laps"), "laps")
    return found.select("run_id", "n_laps", "lap_prompt", "lap_completion", "active_s", "waited_s", F.col("sent_again").cast("long").alias("sent_again"), F.array_join("tool_order", " ").alias("tool_order"))


@Q("stage_shares", f"""
WITH s AS (SELECT arm, unnest(['prompt', 'completion']) AS stage, unnest([sum(prompt_tokens) * 0.15 / 1e6, sum(completion_tokens) * 0.6 / 1e6]) AS total FROM {RACE('arm, prompt_tokens, completion_tokens')} GROUP BY arm)
SELECT arm, stage, round(total, 6) AS total, round(total / sum(total) OVER (PARTITION BY arm), 6) AS share FROM s""")  # fmt: skip
def stage_shares(spark: SparkSession, d: str) -> DataFrame:
    stages = {"prompt": F.col("prompt_tokens") * F.lit(0.15) / 1e6, "completion": F.col("completion_tokens") * F.lit(0.6) / 1e6}
    return traces.stage_shares(races(spark, d, "arm", "prompt_tokens", "completion_tokens"), ["arm"], stages)


def lap_tokens(x: Column) -> Column:
    return F.coalesce(x["prompt_tokens"], F.lit(0)) + F.coalesce(x["completion_tokens"], F.lit(0))


@Q("running_budget", f"""
WITH l AS (SELECT run_id, i - 1 AS pos, laps[i] AS x FROM (SELECT run_id, laps, {_LAPS} FROM {RACE('laps')})),
t AS (SELECT run_id, pos, count(*) OVER w AS calls, coalesce(sum(coalesce(x.prompt_tokens, 0) + coalesce(x.completion_tokens, 0)) OVER w, 0) AS tokens, coalesce(sum(coalesce(x.call_s, 0)) OVER w, 0) AS secs
      FROM l WINDOW w AS (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT run_id, CAST(pos AS INTEGER) AS pos, CASE WHEN calls >= 4 THEN 'laps' WHEN tokens >= 6000 THEN 'tokens' WHEN secs >= 5 THEN 'wall' END AS "limit" FROM t)
SELECT run_id, pos, "limit" FROM h WHERE "limit" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY pos) = 1""")  # fmt: skip
def running_budget(spark: SparkSession, d: str) -> DataFrame:
    limits = [traces.Limit("laps", lambda x: F.lit(1), 4), traces.Limit("tokens", lap_tokens, 6000), traces.Limit("wall", lambda x: x["call_s"], 5.0)]
    return traces.running_budget(races(spark, d, "laps"), "run_id", "laps", limits)


@Q("critical_path", f"SELECT run_id, round(greatest(coalesce(laps[1].call_s, 0), coalesce(laps[2].call_s, 0)) + coalesce(list_sum(list_transform(list_filter(laps[3:], lambda x: x IS NOT NULL), lambda x: x.call_s)), 0), 6) AS seconds FROM {RACE('laps')}")
def critical_path(spark: SparkSession, d: str) -> DataFrame:
    """The first two laps side by side, the others one after the other."""
    at = lambda i: F.coalesce(F.get(F.col("laps"), F.lit(i))["call_s"], F.lit(0.0))
    rest = F.when(F.size("laps") > 2, traces.array_sum(F.slice("laps", 3, F.greatest(F.size("laps"), F.lit(1))), "call_s")).otherwise(0.0)
    return races(spark, d, "laps").select("run_id", F.round(F.greatest(at(0), at(1)) + rest, 6).alias("seconds"))


@Q("capacity", "SELECT requests, tokens, minutes, round(tokens / nullif(minutes_raw, 0), 4) AS tokens_per_minute, round(tokens / 200000.0, 6) AS daily_ratio, round(200000.0 / tokens, 6) AS daily_breaks_at FROM (SELECT count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, round(m, 4) AS minutes, m AS minutes_raw FROM (SELECT tokens, (max(epoch_us(t)) OVER () - min(epoch_us(t)) OVER ()) / 60e6 AS m FROM (SELECT CAST(ts AS TIMESTAMPTZ) AS t, tokens FROM " + EVAL("ts, tokens") + ")) GROUP BY m)")
def capacity(spark: SparkSession, d: str) -> DataFrame:
    return traces.capacity(evals(spark, d, "ts", "tokens"), F.col("ts").try_cast("timestamp"), "tokens", {"daily": 200_000.0})


@Q("rate_limits", f"SELECT r.unit AS unit, count(*) AS n, round(sum(r.wait_s), 6) AS waited_s, max(r.requested) AS most FROM (SELECT unnest(rate_limited) AS r FROM (SELECT trace_id, any_value(rate_limited) AS rate_limited FROM eval_before GROUP BY trace_id)) GROUP BY ALL")
def rate_limits(spark: SparkSession, d: str) -> DataFrame:
    flat = evals(spark, d, "rate_limited").select(F.explode("rate_limited").alias("r"))
    return flat.groupBy("r.unit").agg(F.count("*").alias("n"), F.round(F.sum("r.wait_s"), 6).alias("waited_s"), F.max("r.requested").alias("most"))


# ---- trajectories -------------------------------------------------------------------------

_PATH = f"(SELECT claim_id, list_transform(coalesce(tool_calls, []), lambda c: coalesce(c.tool, '?')) AS path FROM {TRAJ('tool_calls')})"
NEEDS = {"compute_payout": "coverage_in_force", "refer_to_adjuster": "policy_lookup", "search_policy": "get_claim"}


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return trajectories(spark, d, "tool_calls").select("claim_id", F.transform(F.coalesce("tool_calls", F.array()), lambda c: F.coalesce(c["tool"], F.lit("?"))).alias("path"))


@Q("order_rules", f"""
WITH c AS (SELECT claim_id, path, i, path[i] AS tool, CASE path[i] WHEN 'compute_payout' THEN 'coverage_in_force' WHEN 'refer_to_adjuster' THEN 'policy_lookup' WHEN 'search_policy' THEN 'get_claim' END AS missing FROM (SELECT claim_id, path, unnest(range(1, len(path) + 1)) AS i FROM {_PATH}))
SELECT claim_id, CAST(i - 1 AS INTEGER) AS pos, tool, missing FROM c WHERE missing IS NOT NULL AND NOT list_contains(path[1:i - 1], missing)""")  # fmt: skip
def order_rules(spark: SparkSession, d: str) -> DataFrame:
    return traces.order_violations(_paths(spark, d), "claim_id", "path", NEEDS)


_ACCEPT = "get_claim( (policy_lookup|coverage_in_force|search_policy))*( compute_payout)?( refer_to_adjuster)?"


@Q("sequence_accept", f"SELECT claim_id, regexp_full_match(array_to_string(path, ' '), '{_ACCEPT}') AS accepted, CAST(len(path) AS INTEGER) AS steps FROM {_PATH}")
def sequence_accept(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("claim_id", traces.sequence_accepted(F.col("path"), _ACCEPT).alias("accepted"), F.size("path").alias("steps"))


@Q("path_counts", f"SELECT array_to_string(path, ' ') AS path, count(*) AS n FROM {_PATH} GROUP BY 1")
def path_counts(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).groupBy(F.array_join("path", " ").alias("path")).agg(F.count("*").alias("n"))


@Q("retry_after_error", f"""
SELECT claim_id, CAST(e - 1 AS INTEGER) AS failed_at, CAST(len(tool_calls) - e AS INTEGER) AS later FROM (
SELECT claim_id, tool_calls, list_position(list_transform(tool_calls, lambda c: coalesce(contains(c.returned, '"error"'), false)), true) AS e FROM {TRAJ('tool_calls')}) WHERE e > 0""")  # fmt: skip
def retry_after_error(spark: SparkSession, d: str) -> DataFrame:
    """Where a call was first refused, and how many calls came after."""
    refused = F.transform("tool_calls", lambda c: F.coalesce(c["returned"].contains('"error"'), F.lit(False)))
    rows = trajectories(spark, d, "tool_calls").withColumn("e", F.array_position(refused, True))
    return rows.where("e > 0").select("claim_id", (F.col("e") - 1).cast("int").alias("failed_at"), (F.size("tool_calls") - F.col("e")).cast("int").alias("later"))


@Q("trajectory_summary", f"""
SELECT count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS outcome, round(avg(CAST(good AS INT)), 6) AS trajectory, CAST(sum(tokens) AS BIGINT) AS tokens, round(max(cost_usd), 8) AS max_cost FROM (
SELECT claim_id, any_value(outcome_passed) AS ok, any_value(tokens) AS tokens, any_value(cost_usd) AS cost_usd FROM traj_before GROUP BY claim_id) JOIN (SELECT claim_id, regexp_full_match(array_to_string(path, ' '), '{_ACCEPT}') AS good FROM {_PATH}) USING (claim_id)""")  # fmt: skip
def trajectory_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = trajectories(spark, d, "outcome_passed", "tokens", "cost_usd", "tool_calls")
    path = F.transform(F.coalesce("tool_calls", F.array()), lambda c: F.coalesce(c["tool"], F.lit("?")))
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return rows.agg(F.count("*").alias("n"), rate(F.col("outcome_passed")).alias("outcome"), rate(traces.sequence_accepted(path, _ACCEPT)).alias("trajectory"), F.sum("tokens").alias("tokens"), F.round(F.max("cost_usd"), 8).alias("max_cost"))


# ---- order, samples -----------------------------------------------------------------------


@Q("seeded_sample", f"SELECT id FROM {ATT('ts')} ORDER BY sha256(id || ':7'), id LIMIT 20")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return hash_sample(attempts(spark, d), "id", 20, 7)


@Q("stratified_sample", f"SELECT id, tag FROM {ATT('tag')} QUALIFY row_number() OVER (PARTITION BY tag ORDER BY sha256(id || ':7'), id) <= 5")
def stratified(spark: SparkSession, d: str) -> DataFrame:
    return stratified_sample(attempts(spark, d, "tag"), "tag", "id", 5, 7)


@Q("dearest_per_mode", f"SELECT trace_id, mode, cost_usd, row_number() OVER (PARTITION BY mode ORDER BY cost_usd DESC, trace_id) AS rank FROM (SELECT trace_id, any_value(mode) AS mode, any_value(cost_usd) AS cost_usd FROM eval_before GROUP BY trace_id) QUALIFY rank <= 3")
def dearest_per_mode(spark: SparkSession, d: str) -> DataFrame:
    return ranked(evals(spark, d, "mode", "cost_usd"), ["mode"], F.col("cost_usd"), ["trace_id"], 3).withColumn("rank", F.col("rank").cast("long"))


@Q("latest_status", "SELECT claim_id, max(struct_pack(a := reported_at, b := coalesce(status, ''))).b AS status, count(*) AS rows FROM claims GROUP BY claim_id")
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "claims").select("claim_id", "reported_at", F.coalesce("status", F.lit("")).alias("status"))
    counts = rows.groupBy("claim_id").agg(F.count("*").alias("rows"))
    return latest_per_key(rows, ["claim_id"], [F.col("reported_at"), F.col("status")]).select("claim_id", "status").join(counts, "claim_id")


@Q("event_offsets", "SELECT user_id, event_id, epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id)) AS offset_us FROM events")
def event_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Microseconds since the user's first event; an aggregation joined back, no sort."""
    events = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = events.groupBy("user_id").agg(F.min("us").alias("first"))
    return events.join(first, "user_id").select("user_id", "event_id", (F.col("us") - F.col("first")).alias("offset_us"))


# ---- budgets and evidence -----------------------------------------------------------------


@Q("budget_left", f"""
WITH l AS (SELECT run_id, i - 1 AS pos, laps[i] AS x FROM (SELECT run_id, laps, {_LAPS} FROM {RACE('laps')}))
SELECT run_id, CAST(pos AS INTEGER) AS pos, CAST(least(4096, greatest(0, 9000 - coalesce(sum(coalesce(x.prompt_tokens, 0)) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS DOUBLE) AS "left" FROM l""")  # fmt: skip
def budget_left(spark: SparkSession, d: str) -> DataFrame:
    return traces.budget_left(races(spark, d, "laps"), "run_id", "laps", F.col("x.prompt_tokens"), 9000, 4096)


_CLAIM = "CLM-\\d{4}-\\d{8}"


@Q("unseen_claims", f"""
WITH c AS (SELECT claim_id, i - 1 AS pos, tool_calls[i] AS x FROM (SELECT claim_id, tool_calls, unnest(range(1, coalesce(len(tool_calls), 0) + 1)) AS i FROM {TRAJ('tool_calls')})),
u AS (SELECT DISTINCT claim_id, pos, unnest(regexp_extract_all(x.args, '{_CLAIM}')) AS value FROM c),
p AS (SELECT claim_id, value, min(pos) AS since FROM (SELECT claim_id, pos, unnest(regexp_extract_all(coalesce(x.args, '') || coalesce(x.returned, ''), '{_CLAIM}')) AS value FROM c) GROUP BY ALL)
SELECT claim_id, CAST(pos AS INTEGER) AS pos, value FROM u LEFT JOIN p USING (claim_id, value) WHERE since IS NULL OR since >= pos""")  # fmt: skip
def unseen_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claim numbers in arguments that no earlier call of the trajectory had mentioned."""
    ids = lambda c: F.regexp_extract_all(c, F.lit(r"CLM-\d{4}-\d{8}"), F.lit(0))
    both = F.concat(F.coalesce("x.args", F.lit("")), F.coalesce("x.returned", F.lit("")))
    return traces.unseen_values(trajectories(spark, d, "tool_calls"), "claim_id", "tool_calls", ids(F.col("x.args")), ids(both))


@Q("scaled_parts", f"""
WITH r AS (SELECT run_id, tokens, prompt_tokens AS a, completion_tokens AS b FROM {RACE('tokens, prompt_tokens, completion_tokens')}),
s AS (SELECT run_id, tokens * 2 AS t, CAST(coalesce(round(a * (tokens * 2) / nullif(a + b, 0)), 0) AS BIGINT) AS x, CAST(coalesce(round(b * (tokens * 2) / nullif(a + b, 0)), 0) AS BIGINT) AS y FROM r)
SELECT run_id, x + (t - x - y) AS prompt, y AS completion FROM s""")  # fmt: skip
def scaled_parts(spark: SparkSession, d: str) -> DataFrame:
    """Prompt and completion scaled to twice the run's tokens, the rounding left to the prompt."""
    rows = races(spark, d, "tokens", "prompt_tokens", "completion_tokens")
    prompt, completion = traces.scale_to_total([F.col("prompt_tokens"), F.col("completion_tokens")], F.col("tokens").cast("long") * 2)
    return rows.select("run_id", prompt.alias("prompt"), completion.alias("completion"))


@Q("canary_routes", f"SELECT CASE WHEN source IN ('production', 'canary') THEN 'v4' ELSE 'v3' END AS version, count(*) AS n FROM {ATT('source')} GROUP BY 1")
def canary_routes(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.text import route

    return attempts(spark, d, "source").groupBy(route(F.col("source"), ["production", "canary"], "v3", "v4").alias("version")).agg(F.count("*").alias("n"))


@Q("drift_problems", f"SELECT trace_id, array_to_string(list_filter([CASE WHEN NOT coalesce(len(citations) > 0, false) THEN 'cites' END, CASE WHEN NOT coalesce(best_dense_score >= 0.35, false) THEN 'score' END, CASE WHEN error IS NOT NULL THEN 'error' END], lambda x: x IS NOT NULL), ' ') AS problems FROM {DEMO('citations, best_dense_score, error')}")
def drift_problems(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.text import problems

    rows = demos(spark, d, "citations", "best_dense_score", "error")
    found = problems(cites=F.size("citations") > 0, score=F.col("best_dense_score") >= 0.35, error=F.col("error").isNull())
    return rows.select("trace_id", F.array_join(found, " ").alias("problems"))


@Q("banned_words", f"SELECT source, count(*) FILTER (regexp_matches(coalesce(summary, ''), '(?i)\\b(?:covered|uncovered)\\b')) AS hits, count(*) AS n FROM {ATT('source, summary')} GROUP BY source")
def banned_words(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.functions.text import contains_word

    return attempts(spark, d, "source", "summary").groupBy("source").agg(F.count_if(contains_word(F.col("summary"), ["covered", "uncovered"])).alias("hits"), F.count("*").alias("n"))


@Q("named_grounds", f"SELECT id, x.form AS form FROM (SELECT id, unnest(list_distinct(regexp_extract_all(grounds, '[A-Z]{{2}}-\\d{{4}}'))) AS f FROM {ATT('grounds')}), (SELECT DISTINCT form_number AS form FROM chunks) x WHERE f = x.form")
def named_grounds(spark: SparkSession, d: str) -> DataFrame:
    """Forms of the library that stand in the grounds given."""
    from tidemark.operators.relations import containing_texts

    forms = table(spark, d, "chunks").select(F.col("form_number").alias("form"))
    return containing_texts(attempts(spark, d, "grounds"), "id", "grounds", forms, "form", r"[A-Z]{2}-\d{4}")


@Q("best_retrieved", f"SELECT trace_id, r.chunk_id AS chunk_id FROM (SELECT trace_id, unnest(retrieved) AS r FROM {DEMO('retrieved')}) QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY r.score DESC, r.rank DESC) = 1")
def best_retrieved(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.relations import last_best

    flat = demos(spark, d, "retrieved").select("trace_id", F.explode("retrieved").alias("r")).select("trace_id", "r.chunk_id", "r.score", "r.rank")
    return last_best(flat, ["trace_id"], "score", "rank", "chunk_id")
