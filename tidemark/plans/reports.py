"""Reports over graded runs: arms, hops, trajectories, retrieval with and without filters, replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.functions.registry import expect_check, validated
from tidemark.operators import chunking, relations, traces
from tidemark.operators.ranks import LOWER_MIDDLE, UPPER_MIDDLE, nearest_rank, order_statistics
from tidemark.plans.boundaries import fresh_folder
from tidemark.plans.library import _BM25, _TRIM, _lexical, questions
from tidemark.plans.registry import Registry
from tidemark.plans.runs import _ACCEPT, _ARM, _PATH, _RANKED, ATT, DEMO, NEEDS, RACE, TRAJ, _paths, attempts, demos, evals, lap_tokens, races, trajectories
from tidemark.session import cut
from tidemark.sources import files
from tidemark.sources.tables import table

REGISTRY = Registry()
Q = REGISTRY.add
PRICE = {"prompt_tokens": 0.15e-6, "completion_tokens": 0.6e-6}


def _beside(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """``b``'s columns beside ``a``'s by a group that may be null."""
    same = F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}"))
    return a.alias("a").join(b.alias("b"), same, "left").drop(F.col(f"b.{by}"))


# ---- arms, hops, costs ----------------------------------------------------------------------


@Q("arm_report", f"""
WITH s AS (SELECT arm, {_ARM}, count(*) FILTER (stop_reason IS NOT NULL) AS stopped FROM {RACE('arm, stop_reason, prompt_tokens, completion_tokens, cost_usd')} GROUP BY arm),
l AS (SELECT arm, round(median(v), 9) AS median_s, max(v) FILTER (i = greatest(ceil(50 * n / 100.0), 1)) AS p50_s, max(v) FILTER (i = greatest(ceil(99 * n / 100.0), 1)) AS p99_s FROM {_RANKED} GROUP BY arm, n)
SELECT s.*, median_s, p50_s, p99_s FROM s LEFT JOIN l ON s.arm IS NOT DISTINCT FROM l.arm""")  # fmt: skip
def arm_report(spark: SparkSession, d: str) -> DataFrame:
    """Each arm's counts, sums, mean cost, and latency at the middle and the ends."""
    rows = cut(races(spark, d, "arm", "stop_reason", "prompt_tokens", "completion_tokens", "cost_usd", "latency_s"))
    sums = traces.arm_summary(rows, "arm", F.col("stop_reason").isNull())
    stopped = rows.groupBy("arm").agg(F.count("stop_reason").alias("stopped"))
    ranks = order_statistics(rows, ["arm"], "latency_s", {"lo": LOWER_MIDDLE, "hi": UPPER_MIDDLE, "p50_s": nearest_rank(50), "p99_s": nearest_rank(99)})
    ranks = ranks.select("arm", F.round((F.col("lo") + F.col("hi")) / 2, 9).alias("median_s"), "p50_s", "p99_s")
    return _beside(_beside(sums, stopped, "arm"), ranks, "arm")


@Q("hop_totals", f"""
SELECT CAST(i - 1 AS INTEGER) AS hop, count(*) AS calls, CAST(sum(x.prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(x.completion_tokens) AS BIGINT) AS completion_tokens, round(sum(x.call_s), 4) AS call_s, round(sum(x.wait_s), 4) AS wait_s
FROM (SELECT i, laps[i] AS x FROM (SELECT laps, unnest(range(1, coalesce(len(laps), 0) + 1)) AS i FROM {RACE('laps')})) GROUP BY i""")  # fmt: skip
def hop_totals(spark: SparkSession, d: str) -> DataFrame:
    """What is spent at each hand-over, by its place in the trace."""
    hops = races(spark, d, "laps").select(F.posexplode("laps").alias("hop", "x"))
    total = lambda c: F.sum(f"x.{c}").alias(c)
    long = lambda c: F.round(F.sum(f"x.{c}"), 4).alias(c)
    return hops.groupBy("hop").agg(F.count("*").alias("calls"), total("prompt_tokens"), total("completion_tokens"), long("call_s"), long("wait_s"))


@Q("hop_ledger", f"""
SELECT run_id, CAST(i - 1 AS INTEGER) AS hop, CAST(sum(coalesce(x.prompt_tokens, 0) + coalesce(x.completion_tokens, 0)) OVER (PARTITION BY run_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent
FROM (SELECT run_id, i, laps[i] AS x FROM (SELECT run_id, laps, unnest(range(1, coalesce(len(laps), 0) + 1)) AS i FROM {RACE('laps')}))""")  # fmt: skip
def hop_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Tokens spent up to and with each hop; folded inside the row, no shuffle after the copies are gone."""
    costs = F.transform("laps", lambda x: F.coalesce(lap_tokens(x), F.lit(0)).cast("bigint"))
    upto = lambda i: F.aggregate(F.slice("_c", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = races(spark, d, "laps").withColumn("_c", costs)
    return rows.select("run_id", "_c", F.posexplode("_c").alias("hop", "_x")).select("run_id", "hop", upto(F.col("hop")).alias("spent"))


@Q("budget_limits", f"""
WITH l AS (SELECT run_id, i - 1 AS pos, laps[i] AS x FROM (SELECT run_id, laps, unnest(range(1, coalesce(len(laps), 0) + 1)) AS i FROM {RACE('laps')})),
t AS (SELECT run_id, pos, count(*) OVER w AS calls, coalesce(sum(coalesce(x.prompt_tokens, 0) + coalesce(x.completion_tokens, 0)) OVER w, 0) AS tokens, coalesce(sum(coalesce(x.call_s, 0)) OVER w, 0) AS secs,
  coalesce(sum(coalesce(x.prompt_tokens, 0) * 0.15e-6 + coalesce(x.completion_tokens, 0) * 0.6e-6) OVER w, 0) AS cost FROM l WINDOW w AS (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT run_id, CAST(pos AS INTEGER) AS pos, CASE WHEN calls >= 6 THEN 'laps' WHEN tokens >= 9000 OR 9000 - tokens < 700 THEN 'tokens' WHEN cost >= 0.0019 THEN 'cost' WHEN secs >= 9 THEN 'wall' END AS "limit" FROM t)
SELECT run_id, pos, "limit" FROM h WHERE "limit" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY pos) = 1""")  # fmt: skip
def budget_limits(spark: SparkSession, d: str) -> DataFrame:
    """All limits in their order: laps, tokens with room for one more answer, cost, wall clock."""
    cost = lambda x: sum((F.coalesce(x[c], F.lit(0)) * F.lit(p) for c, p in PRICE.items()), F.lit(0.0))
    limits = [traces.Limit("laps", lambda x: F.lit(1), 6), traces.Limit("tokens", lap_tokens, 9000, 700), traces.Limit("cost", cost, 0.0019), traces.Limit("wall", lambda x: x["call_s"], 9.0)]
    return traces.running_budget(races(spark, d, "laps"), "run_id", "laps", limits)


@Q("case_costs", f"""
WITH r AS (SELECT coalesce(arm, '-') AS arm, tokens, calls FROM {RACE('arm, tokens, calls')}),
k AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY tokens) AS i, count(*) OVER (PARTITION BY arm) AS n FROM r)
SELECT arm, count(*) AS n, round(avg(tokens), 4) AS mean_tokens, max(tokens) FILTER (i = greatest(ceil(50 * n / 100.0), 1)) AS p50_tokens, max(tokens) AS most_tokens, round(avg(calls), 4) AS mean_calls,
  round(18000 / 7.0 * avg(tokens) / 200000, 4) AS surge_ratio, round(1800 / 30.0 * avg(tokens) / 200000, 4) AS normal_ratio FROM k GROUP BY arm""")  # fmt: skip
def case_costs(spark: SparkSession, d: str) -> DataFrame:
    """Mean, middle and most tokens of a case, and what a surge of 18,000 cases a week and a
    normal month of 1,800 need of a daily limit of 200,000 tokens."""
    rows = cut(races(spark, d, "arm", "tokens", "calls").withColumn("arm", F.coalesce("arm", F.lit("-"))))
    mean = F.avg("tokens")
    sums = rows.groupBy("arm").agg(
        F.round(mean, 4).alias("mean_tokens"), F.max("tokens").alias("most_tokens"), F.round(F.avg("calls"), 4).alias("mean_calls"),
        F.round(F.lit(18000) / 7.0 * mean / 200000, 4).alias("surge_ratio"), F.round(F.lit(1800) / 30.0 * mean / 200000, 4).alias("normal_ratio"),
    )
    return sums.join(order_statistics(rows, ["arm"], "tokens", {"p50_tokens": nearest_rank(50)}), "arm")


# ---- trajectories ---------------------------------------------------------------------------

_NEED = "CASE path[i] " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in NEEDS.items()) + " END"
_BROKEN = f"(SELECT claim_id, path, len(list_filter(range(1, len(path) + 1), lambda i: {_NEED} IS NOT NULL AND NOT list_contains(path[1:i - 1], {_NEED}))) AS broken FROM {_PATH})"


def _broken(path: Column) -> Column:
    """How many calls of a path come before the one they need."""
    need = F.create_map(*(F.lit(x) for kv in NEEDS.items() for x in kv))
    early = F.transform(path, lambda tool, i: F.coalesce(F.try_element_at(need, tool).isNotNull() & ~F.array_contains(F.slice(path, F.lit(1), i), F.try_element_at(need, tool)), F.lit(False)))
    return F.size(F.filter(early, lambda e: e)).cast("bigint")


@Q("trajectory_scores", f"SELECT claim_id, broken, round(CAST(len(list_distinct(path)) AS DOUBLE) / nullif(len(path), 0), 6) AS efficiency, broken = 0 AND regexp_full_match(array_to_string(path, ' '), '{_ACCEPT}') AS passed FROM {_BROKEN}")
def trajectory_scores(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules, distinct calls per call, and whether order and rules hold."""
    p = F.col("path")
    ok = (_broken(p) == 0) & traces.sequence_accepted(p, _ACCEPT)
    return _paths(spark, d).select("claim_id", _broken(p).alias("broken"), F.round(F.try_divide(F.size(F.array_distinct(p)).cast("double"), F.size(p)), 6).alias("efficiency"), ok.alias("passed"))


@Q("tool_choice", f"""
SELECT count(*) AS n, CAST(sum(len(path)) AS BIGINT) AS calls, round(1 - sum(broken) / sum(len(path)), 6) AS accuracy, round(avg(CAST(ok AS INT)), 6) AS outcome, round(avg(CAST(broken = 0 AS INT)), 6) AS trajectory,
  round(avg(CAST(ok AS INT)) - avg(CAST(broken = 0 AS INT)), 6) AS gap FROM {_BROKEN} JOIN (SELECT claim_id, any_value(outcome_passed) AS ok FROM traj_before GROUP BY claim_id) USING (claim_id)""")  # fmt: skip
def tool_choice(spark: SparkSession, d: str) -> DataFrame:
    """The share of calls made in a right place, and how outcome and trajectory differ."""
    path = F.transform(F.coalesce("tool_calls", F.array()), lambda c: F.coalesce(c["tool"], F.lit("?")))
    rows = trajectories(spark, d, "tool_calls", "outcome_passed").select(path.alias("path"), "outcome_passed").withColumn("broken", _broken(F.col("path")))
    share = lambda c: F.avg(c.cast("int"))
    good, calls = F.col("broken") == 0, F.sum(F.size("path"))
    return rows.agg(
        F.count("*").alias("n"), calls.alias("calls"), F.round(1 - F.sum("broken") / calls, 6).alias("accuracy"), F.round(share(F.col("outcome_passed")), 6).alias("outcome"),
        F.round(share(good), 6).alias("trajectory"), F.round(share(F.col("outcome_passed")) - share(good), 6).alias("gap"),
    )


_TRAJ_ROWS = "(SELECT claim_id, any_value(outcome_passed) AS ok, any_value(tokens) AS tokens, any_value(cost_usd) AS cost_usd, any_value(latency_s) AS latency_s FROM traj_before GROUP BY claim_id)"


@Q("trajectory_report", f"SELECT count(*) AS n, round(avg(CAST(ok AS INT)), 6) AS outcome, round(median(tokens), 6) AS median_tokens, round(median(latency_s), 9) AS median_s, CAST(sum(tokens) AS BIGINT) AS tokens, round(max(cost_usd), 8) AS max_cost, round(sum(cost_usd), 6) AS cost FROM {_TRAJ_ROWS}")
def trajectory_report(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(trajectories(spark, d, "outcome_passed", "tokens", "cost_usd", "latency_s").withColumn("all", F.lit(1)))
    middle = {"lo": LOWER_MIDDLE, "hi": UPPER_MIDDLE}
    medians = [order_statistics(rows, ["all"], c, middle).select("all", F.round((F.col("lo") + F.col("hi")) / 2, digits).alias(name)) for c, name, digits in (("tokens", "median_tokens", 6), ("latency_s", "median_s", 9))]
    sums = rows.groupBy("all").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("outcome_passed").cast("int")), 6).alias("outcome"), F.sum("tokens").alias("tokens"), F.round(F.max("cost_usd"), 8).alias("max_cost"), F.round(F.sum("cost_usd"), 6).alias("cost")
    )
    return sums.join(medians[0], "all").join(medians[1], "all").drop("all")


# ---- checks and answers ---------------------------------------------------------------------

CHECKS = ("no_covered", "referred", "in_force_checked", "assessment", "cites", "edition", "loss_date", "numbers", "signed")


@Q("check_failures", f"""
WITH f AS (SELECT c.name AS name FROM (SELECT unnest(c) AS c FROM (SELECT first(checks) AS c FROM eval_before GROUP BY trace_id)) WHERE NOT c.passed)
SELECT CAST(place AS INTEGER) AS place, k.name AS name, count(f.name) AS failed FROM (SELECT unnest({list(CHECKS)}) AS name, unnest(range({len(CHECKS)})) AS place) k LEFT JOIN f USING (name) GROUP BY ALL""")  # fmt: skip
def check_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failures of a fixed list of checks in its order, none as 0."""
    listed = spark.createDataFrame(list(enumerate(CHECKS)), "place int, name string")
    failed = evals(spark, d, "checks").select(F.explode("checks").alias("c")).where(~F.col("c.passed")).groupBy("c.name").agg(F.count("*").alias("failed"))
    return F.broadcast(listed).join(failed, "name", "left").select("place", "name", F.coalesce("failed", F.lit(0)).alias("failed"))  # nine rows


#: What cases of a source expect, as data: positions forbidden, positions allowed, codes to cite.
EXPECTED = [("production", ["UNDETERMINED"], [], ["E-77", "E-96"]), ("case-file", [], ["COVERED", "PARTIAL"], []), ("other", [], [], [])]


@Q("expectations", f"""
WITH x AS (SELECT * FROM (VALUES {', '.join(f"('{s}', {n}::VARCHAR[], {i}::VARCHAR[], {c}::VARCHAR[])" for s, n, i, c in EXPECTED)}) t(source, pn, pi, mc)),
a AS (SELECT source, upper(coalesce(pos, '')) AS p, translate(coalesce(grounds, ''), '‐‑‒–—−', '------') AS g, pn, pi, mc FROM {ATT('source, "position", grounds').replace('any_value("position") AS "position"', 'any_value("position") AS pos')} JOIN x USING (source))
SELECT source, why, why IN ('nothing expected', 'as expected') AS ok, count(*) AS n FROM (SELECT source, CASE WHEN len(pn) + len(pi) + len(mc) = 0 THEN 'nothing expected' WHEN list_contains(pn, p) THEN 'position forbidden' WHEN len(pi) > 0 AND NOT list_contains(pi, p) THEN 'position not allowed'
  WHEN len(mc) > 0 AND len(list_filter(mc, lambda c: contains(g, c))) = 0 THEN 'no code cited' ELSE 'as expected' END AS why FROM a) GROUP BY ALL""")  # fmt: skip
def expectations(spark: SparkSession, d: str) -> DataFrame:
    """Answers against what the cases of their source expect."""
    wanted = spark.createDataFrame(EXPECTED, "source string, forbidden array<string>, allowed array<string>, cite array<string>")
    rows = attempts(spark, d, "source", "position", "grounds").join(F.broadcast(wanted), "source")  # three rows
    found = expect_check(F.col("position"), F.col("grounds"), F.col("forbidden"), F.col("allowed"), F.col("cite"))
    return rows.select("source", found.alias("e")).groupBy("source", "e.why", "e.ok").agg(F.count("*").alias("n"))


@Q("reply_errors", rf"""
WITH c AS (SELECT unnest(tool_calls) AS c FROM {TRAJ('tool_calls')}), t AS (SELECT c.tool AS tool, c.args AS a, nullif(regexp_extract(c.args, '(?s)\{{.*\}}', 0), '') AS j FROM c WHERE c IS NOT NULL)
SELECT tool, coalesce(CASE WHEN trim(coalesce(a, '')) = '' THEN 'empty reply' WHEN j IS NULL THEN 'no JSON object' WHEN NOT json_valid(j) THEN 'invalid JSON' WHEN NOT json_exists(j, '$.claim_id') THEN 'missing keys: claim_id'
  WHEN json_exists(j, '$.excess') AND json_type(j, '$.excess') NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'NULL') THEN 'excess is no number' END, 'ok') AS error, count(*) AS n FROM t GROUP BY ALL""")  # fmt: skip
def reply_errors(spark: SparkSession, d: str) -> DataFrame:
    """Arguments read as replies that should hold a JSON object with a claim number."""
    calls = trajectories(spark, d, "tool_calls").select(F.explode("tool_calls").alias("c")).where("c IS NOT NULL")
    read = calls.select(F.col("c.tool").alias("tool"), validated(F.col("c.args"), ["claim_id"], ["excess"]).alias("v"))
    return read.groupBy("tool", F.coalesce("v.error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@Q("form_suggestions", r"""
WITH f AS (SELECT DISTINCT f AS raw FROM (SELECT unnest(forms_attached) AS f FROM claims) WHERE f IS NOT NULL), h AS (SELECT raw, regexp_replace(trim(raw), '(?i)\s+ed\.?\s*[\d-]+$', '') AS head FROM f),
g AS (SELECT raw, regexp_replace(upper(head), '[^A-Z]', '', 'g') || '-' || regexp_replace(head, '[^0-9]', '', 'g') AS guess FROM h)
SELECT raw, guess, guess IN (SELECT form_number FROM chunks) AS held FROM g""")  # fmt: skip
def form_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Form names as attached, what was probably meant, and whether the library holds it."""
    raw = table(spark, d, "claims").select(F.explode("forms_attached").alias("raw")).where("raw IS NOT NULL").distinct()
    held = table(spark, d, "chunks").select(F.col("form_number").alias("guess")).where("guess IS NOT NULL").distinct().withColumn("held", F.lit(True))
    return raw.withColumn("guess", keys.form_guess(F.col("raw"))).join(held, "guess", "left").select("raw", "guess", F.coalesce("held", F.lit(False)).alias("held"))


@Q("resumed_runs", f"""
WITH r AS (SELECT run_id, id, coalesce(arm, '-') AS arm, cases_sha FROM {RACE('id, arm, cases_sha')}), i AS (SELECT DISTINCT id, cases_sha FROM r WHERE arm = 'squad'), x AS (SELECT DISTINCT arm, id, cases_sha FROM r WHERE arm IN ('single', '-'))
SELECT arm, id FROM (SELECT a.arm, i.id FROM i, (VALUES ('single'), ('-')) a(arm) WHERE i.id NOT IN (SELECT x.id FROM x WHERE x.arm = a.arm) OR EXISTS (SELECT 1 FROM x WHERE x.arm = a.arm AND x.cases_sha NOT IN (SELECT cases_sha FROM i)))""")  # fmt: skip
def resumed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Cases of one arm still to be run if the work of another is taken over: all of them where
    that work was done on other inputs."""
    rows = cut(races(spark, d, "id", "arm", "cases_sha").withColumn("arm", F.coalesce("arm", F.lit("-"))))
    items = rows.where("arm = 'squad'").select("id", "cases_sha").distinct()
    parts = [relations.resume(items, rows.where(F.col("arm") == a), "id", ["cases_sha"]).select(F.lit(a).alias("arm"), "id") for a in ("single", "-")]
    return parts[0].unionByName(parts[1])


# ---- retrieval and chunks -------------------------------------------------------------------

_FIT = "policy_line = 'homeowners' AND in_force_from <= 20240630 AND in_force_to >= 20240630"


@Q("filter_hit_rates", f"""
WITH {_BM25}, fit AS (SELECT chunk_id FROM chunks WHERE {_FIT} GROUP BY chunk_id),
whole AS (SELECT trace_id, chunk_id, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, chunk_id) AS rank FROM lex QUALIFY rank <= 3),
part AS (SELECT trace_id, chunk_id, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, chunk_id) AS rank FROM lex JOIN fit USING (chunk_id) QUALIFY rank <= 3)
SELECT 'all' AS searched, count(*) AS found, count(*) FILTER (chunk_id IN (SELECT chunk_id FROM fit)) AS in_force, count(*) FILTER (rank = 1 AND chunk_id IN (SELECT chunk_id FROM fit)) AS first_in_force FROM whole
UNION ALL SELECT 'filtered', count(*), count(*) FILTER (chunk_id IN (SELECT chunk_id FROM fit)), count(*) FILTER (rank = 1 AND chunk_id IN (SELECT chunk_id FROM fit)) FROM part""")  # fmt: skip
def filter_hit_rates(spark: SparkSession, d: str) -> DataFrame:
    """How many of the three best are in force on a day, searched with and without the date filter."""
    fit = table(spark, d, "chunks").where(_FIT).select("chunk_id").distinct().withColumn("in_force", F.lit(True))

    def row(name: str, hits: DataFrame) -> DataFrame:
        held = hits.join(fit, "chunk_id", "left")
        return held.agg(F.count("*").alias("found"), F.count_if("in_force").alias("in_force"), F.count_if(F.col("in_force") & (F.col("rank") == 1)).alias("first_in_force")).select(F.lit(name).alias("searched"), "*")

    return row("all", _lexical(spark, d, 3)).unionByName(row("filtered", _lexical(spark, d, 3, among=fit)))


@Q("retriever_report", f"""
WITH r AS (SELECT retriever, latency_ms, nullif(list_position(list_transform(retrieved, lambda x: x.chunk_id), citations[1]), 0) AS rank FROM {DEMO('retriever, retrieved, citations, latency_ms')}),
k AS (SELECT *, row_number() OVER (PARTITION BY retriever ORDER BY latency_ms) AS i, count(*) OVER (PARTITION BY retriever) AS n FROM r)
SELECT retriever, count(*) AS n, count(*) FILTER (rank <= 3) AS hits, max(latency_ms) FILTER (i = greatest(ceil(50 * n / 100.0), 1)) AS p50_ms FROM k GROUP BY retriever""")  # fmt: skip
def retriever_report(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the first citation and the middle latency, by retriever."""
    rank = F.nullif(F.array_position(F.transform("retrieved", lambda x: x["chunk_id"]), F.get("citations", F.lit(0))), F.lit(0))
    rows = cut(demos(spark, d, "retriever", "retrieved", "citations", "latency_ms").select("retriever", "latency_ms", rank.alias("rank")))
    sums = rows.groupBy("retriever").agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= 3).alias("hits"))
    return sums.join(order_statistics(rows, ["retriever"], "latency_ms", {"p50_ms": nearest_rank(50)}).drop("n"), "retriever")


_CLEAN = "replace(replace(text, chr(31), ''), chr(30), '')"


@Q("chunk_lines", f"""
WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM (SELECT doc_id, {_CLEAN} AS t FROM documents WHERE text IS NOT NULL)),
b AS (SELECT *, {_TRIM.format('line')} = '' AS blank FROM l), g AS (SELECT *, sum(CAST(blank AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM b),
p AS (SELECT doc_id, min(i) AS start_line, {_TRIM.format("string_agg(line, chr(10) ORDER BY i)")} AS p FROM g WHERE NOT blank GROUP BY doc_id, run),
x AS (SELECT doc_id, list(start_line || chr(30) || p ORDER BY start_line) AS ps FROM p GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce(ps, lambda acc, x: CASE WHEN length(string_split(string_split(acc, chr(31))[-1], chr(30))[2]) + length(string_split(x, chr(30))[2]) > 400 THEN acc || chr(31) || x ELSE acc || chr(10) || chr(10) || string_split(x, chr(30))[2] END) AS packed FROM x),
u AS (SELECT doc_id, unnest(string_split(packed, chr(31))) AS c, unnest(range(len(string_split(packed, chr(31))))) AS pos FROM f)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(string_split(c, chr(30))[1] AS INTEGER) AS line, md5(string_split(c, chr(30))[2]) AS chunk FROM u""")  # fmt: skip
def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    """Packed chunks of every document with the line each starts at."""
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    packed = chunking.pack_with_lines(F.regexp_replace("text", "[\x1e\x1f]", ""), 400)
    return rows.select("doc_id", F.posexplode(packed).alias("pos", "c")).select("doc_id", "pos", "c.line", F.md5("c.chunk").alias("chunk"))


@Q("chunker_hits", f"""
WITH t AS (SELECT doc_id, lower(text) AS text FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(list_transform(range(0, greatest(length(text), 1), 350), lambda i: substr(text, CAST(i AS INTEGER) + 1, 400))) AS c FROM t),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c FROM t)
SELECT strategy, count(*) FILTER (contains(c, 'water') AND contains(c, 'damage')) AS hits, count(DISTINCT CASE WHEN contains(c, 'water') AND contains(c, 'damage') THEN doc_id END) AS docs FROM (SELECT 'fixed' AS strategy, * FROM w UNION ALL SELECT 'lines', * FROM l) GROUP BY strategy""")  # fmt: skip
def chunker_hits(spark: SparkSession, d: str) -> DataFrame:
    """Two ways of cutting compared: pieces that hold both words, and documents with one."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.lower("text").alias("text"))
    cuts = {"fixed": chunking.fixed_windows(F.col("text")), "lines": F.split("text", "\n")}
    both = F.col("c").contains("water") & F.col("c").contains("damage")
    parts = [rows.select(F.lit(n).alias("strategy"), "doc_id", F.explode(c).alias("c")) for n, c in cuts.items()]
    return parts[0].unionByName(parts[1]).groupBy("strategy").agg(F.count_if(both).alias("hits"), F.countDistinct(F.when(both, F.col("doc_id"))).alias("docs"))


# ---- logs -----------------------------------------------------------------------------------


@Q("audit_lines", f"SELECT ts, substr(trace_id, 1, 4) AS token, retriever AS tool, trace_id AS claim FROM {DEMO('ts, retriever')}")
def audit_lines(spark: SparkSession, d: str) -> DataFrame:
    """One line a request in an access log, read back into fields; other lines are left out."""
    out = fresh_folder(spark, "audit")
    line = F.format_string("%s token=%s tool=%s claim=%s", "ts", F.substring("trace_id", 1, 4), "retriever", "trace_id")
    demos(spark, d, "ts", "retriever").select(line.alias("value")).write.text(out)
    spark.range(3).select(F.lit("server started").alias("value")).write.mode("append").text(out)
    return files.access_log(spark, out)


@Q("server_spans", f"SELECT trace_id, retriever AS tool, latency_ms, substr(ts, 1, 10) AS day FROM {DEMO('ts, retriever, latency_ms')}")
def server_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans appended to a log of days in two batches, read back together."""
    out = fresh_folder(spark, "spans")
    spans = cut(demos(spark, d, "ts", "retriever", "latency_ms").withColumnRenamed("retriever", "tool"))
    late = F.pmod(F.xxhash64("trace_id"), F.lit(2)) == 0
    files.append_day_log(spans.where(~late), out)
    files.append_day_log(spans.where(late), out)
    return files.day_log(spark, out, "trace_id string, ts string, tool string, latency_ms int").select("trace_id", "tool", "latency_ms", "day")


@Q("drawn_stamps", f"""
WITH r AS (SELECT id, substr(ts, 1, 10) AS day, epoch_us(CAST(ts AS TIMESTAMPTZ)) AS us FROM {ATT('ts')}), w AS (SELECT day, min(us) AS a, max(us) AS b FROM r GROUP BY day)
SELECT day, CAST(floor(a + (b - a) * (0.15 + 0.7 * CAST('0x' || substr(sha256(day || ':7'), 1, 8) AS BIGINT) / 4294967296.0)) AS BIGINT) AS us FROM w""")  # fmt: skip
def drawn_stamps(spark: SparkSession, d: str) -> DataFrame:
    """An instant in the middle 70 % of each day's log, drawn by a seeded hash."""
    rows = attempts(spark, d, "ts").select(F.substring("ts", 1, 10).alias("day"), F.unix_micros(keys.instant(F.col("ts"))).alias("us"))
    draw = F.conv(F.substring(F.sha2(F.concat("day", F.lit(":7")), 256), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    spans = rows.groupBy("day").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    return spans.select("day", F.floor(F.col("a") + (F.col("b") - F.col("a")) * (0.15 + 0.7 * draw)).alias("us"))
