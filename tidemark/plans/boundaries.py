"""Queries through the engine's edges: files written and read back, tools, checks and messages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.registry import ToolRegistry, run_checks
from tidemark.operators import relations
from tidemark.plans.library import RULES, _rule_sql
from tidemark.plans.registry import Registry
from tidemark.plans.runs import ATT, DEMO, EVAL, TRAJ, attempts, demos, evals, trajectories
from tidemark.session import cut
from tidemark.sources import files
from tidemark.sources.tables import table

REGISTRY = Registry()
Q = REGISTRY.add


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the storage that all executors share."""
    cut(spark.range(1))  # makes sure there is a checkpoint folder
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@Q("redacted_day_log", f"SELECT trace_id, substr(ts, 1, 10) AS day, {_rule_sql('question')} AS question FROM {DEMO('ts, question')} WHERE question IS NOT NULL")
def redacted_day_log(spark: SparkSession, d: str) -> DataFrame:
    """Questions redacted, checked and appended to a log of day folders, then read back."""
    out = fresh_folder(spark, "log")
    rows = demos(spark, d, "ts", "question").where("question IS NOT NULL").withColumn("question", tx.redact(F.col("question"), RULES))
    files.append_day_log(rows, out, checks=[("a question is not clean", tx.is_clean(F.col("question"), RULES))])
    return files.day_log(spark, out, "trace_id string, ts string, question string").select("trace_id", "day", "question")


@Q("one_day_of_log", f"SELECT trace_id, ts FROM {DEMO('ts')} WHERE substr(ts, 1, 10) = (SELECT max(substr(ts, 1, 10)) FROM demo)")
def one_day_of_log(spark: SparkSession, d: str) -> DataFrame:
    """The last day of the log: its folder is the only one read."""
    out = fresh_folder(spark, "log")
    files.append_day_log(demos(spark, d, "ts"), out)
    last = table(spark, d, "demo").agg(F.max(F.substring("ts", 1, 10))).first()[0]
    return files.day_log(spark, out, "trace_id string, ts string", last).select("trace_id", "ts")


@Q("run_file", f"SELECT trace_id, judge, 'before' AS tag FROM {EVAL('judge')} WHERE judge IS NOT NULL")
def run_file(spark: SparkSession, d: str) -> DataFrame:
    """A run file with a header row and an item row per verdict, taken apart again."""
    out = fresh_folder(spark, "run")
    items = evals(spark, d, "judge").where("judge IS NOT NULL").select(F.to_json(F.struct("trace_id", "judge")).alias("value"))
    header = spark.range(1).select(F.to_json(F.struct(F.lit("header").alias("type"), F.lit("before").alias("tag"))).alias("value"))
    header.unionByName(items).write.text(out)
    head, rows = files.run_file(spark, out, "tag string", "trace_id string, judge string")
    return rows.join(F.broadcast(head))  # one row


@Q("json_map_table", "SELECT subject AS key, description FROM subjects")
def json_map_table(spark: SparkSession, d: str) -> DataFrame:
    """A small keyed table as one JSON document and back."""
    out = fresh_folder(spark, "map")
    entries = F.map_from_entries(F.collect_list(F.struct("subject", F.struct("description"))))
    table(spark, d, "subjects").agg(F.to_json(entries).alias("value")).coalesce(1).write.text(out)
    return files.json_map(spark, out, "description: string")


@Q("csv_report", f"SELECT claim_id, array_to_string(outcome_fail_reasons, '; ') AS reasons, round(cost_usd, 6) AS cost FROM (SELECT claim_id, any_value(outcome_fail_reasons) AS outcome_fail_reasons, any_value(cost_usd) AS cost_usd FROM traj_before GROUP BY claim_id)")
def csv_report(spark: SparkSession, d: str) -> DataFrame:
    out = fresh_folder(spark, "csv")
    files.write_csv(trajectories(spark, d, "outcome_fail_reasons", "cost_usd"), out)
    back = spark.read.schema("claim_id string, reasons string, cost double").option("header", True).option("enforceSchema", True).csv(out)
    return back.select("claim_id", F.coalesce("reasons", F.lit("")).alias("reasons"), "cost")


@Q("json_lines_folder", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def json_lines_folder(spark: SparkSession, d: str) -> DataFrame:
    """All documents through JSON lines and back, those with line ends and empty ones too."""
    out = fresh_folder(spark, "docs")
    table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").write.json(out)
    return files.json_lines(spark, out, "doc_id bigint, text string", strict=True)


# ---- tools and checks ---------------------------------------------------------------------


def desk_tools() -> ToolRegistry:
    tools = ToolRegistry()
    tools.tool("get_claim", "claim_id")(lambda claim_id, **_: {"claim_id": claim_id})
    tools.tool("search_policy", "query")(lambda query, form_numbers=None, **_: {"words": len(query.split())})
    return tools


@Q("tool_answers", f"""
WITH c AS (SELECT unnest(tool_calls) AS c FROM {TRAJ('tool_calls')}), j AS (SELECT c.tool AS tool, CASE WHEN json_valid(coalesce(c.args, '{{}}')) THEN CASE WHEN json_type(coalesce(c.args, '{{}}')) = 'VARCHAR' THEN json_extract_string(c.args, '$') ELSE coalesce(c.args, '{{}}') END END AS args FROM c WHERE c IS NOT NULL)
SELECT tool, CASE WHEN tool IS NULL OR tool NOT IN ('get_claim', 'search_policy') THEN 'unknown tool' WHEN args IS NULL OR json_type(args, CASE tool WHEN 'get_claim' THEN '$.claim_id' ELSE '$.query' END) IS NULL THEN 'bad arguments' ELSE 'ok' END AS outcome, count(*) AS n FROM j GROUP BY ALL""")  # fmt: skip
def tool_answers(spark: SparkSession, d: str) -> DataFrame:
    """Recorded calls through the registry: answered, unknown tool, or bad arguments."""
    calls = trajectories(spark, d, "tool_calls").select(F.explode("tool_calls").alias("c")).where("c IS NOT NULL")
    done = calls.select(F.col("c.tool").alias("tool"), desk_tools().column(F.col("c.tool"), F.col("c.args")).alias("r"))
    outcome = F.when(F.col("r.error").isNull(), "ok").otherwise(F.regexp_extract("r.error", "^(unknown tool|bad arguments)", 1))
    return done.groupBy("tool", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@Q("check_runner", f"""
WITH a AS {ATT('summary, tokens, ts')}
SELECT name, count(*) AS n, count(*) FILTER (passed) AS passed FROM (
SELECT 'position stated' AS name, regexp_matches(summary, '(?im)^COVERAGE POSITION: *[A-Z]') AS passed FROM a UNION ALL SELECT 'excess numeric', regexp_matches(summary, '(?m)^EXCESS: *\\d+ *$') FROM a UNION ALL SELECT 'short', tokens < 4000 FROM a) GROUP BY name""")  # fmt: skip
def check_runner(spark: SparkSession, d: str) -> DataFrame:
    """A list of pluggable checks over every summary, counted by name."""
    t = F.col("summary")
    checks = {
        "position stated": (tx.labelled(t, "COVERAGE POSITION").rlike("^[A-Za-z]"), tx.labelled(t, "COVERAGE POSITION")),
        "excess numeric": (tx.labelled(t, "EXCESS").rlike(r"^\d+$"), tx.labelled(t, "EXCESS")),
        "short": (F.col("tokens") < 4000, F.col("tokens")),
    }
    flat = run_checks(attempts(spark, d, "summary", "tokens"), checks).select(F.explode("checks").alias("c"))
    return flat.groupBy("c.name").agg(F.count("*").alias("n"), F.count_if("c.passed").alias("passed"))


@Q("quota_messages", f"SELECT trace_id, r.unit AS unit, r.limit AS \"limit\", r.used AS used, r.requested AS requested, r.wait_s AS wait_s FROM (SELECT trace_id, unnest(rl) AS r FROM (SELECT trace_id, any_value(rate_limited) AS rl FROM eval_before GROUP BY trace_id))")
def quota_messages(spark: SparkSession, d: str) -> DataFrame:
    """Quota messages as a service would write them, read back into fields."""
    flat = evals(spark, d, "rate_limited").select("trace_id", F.explode("rate_limited").alias("r"))
    wait = F.format_string("%dm%ss", F.floor(F.col("r.wait_s") / 60), F.round(F.pmod("r.wait_s", F.lit(60.0)), 3).cast("string"))
    said = F.format_string("Rate limit on %s: Limit %d, Used %d, Requested %d. Try again in %s.", "r.unit", "r.limit", "r.used", "r.requested", wait)
    q = flat.select("trace_id", tx.quota_fields(said).alias("q"))
    return q.select("trace_id", "q.unit", F.col("q.limit").cast("int").alias("limit"), F.col("q.used").cast("int").alias("used"), F.col("q.requested").cast("int").alias("requested"), F.round("q.wait_s", 3).alias("wait_s"))


@Q("rendered_lines", f"SELECT trace_id, 'trace ' || trace_id || ' via ' || retriever || ' took ' || CAST(latency_ms AS VARCHAR) || ' ms' AS line FROM {DEMO('retriever, latency_ms')}")
def rendered_lines(spark: SparkSession, d: str) -> DataFrame:
    line = tx.render("trace {id} via {how} took {ms} ms", {"id": F.col("trace_id"), "how": F.col("retriever"), "ms": F.col("latency_ms")})
    return demos(spark, d, "retriever", "latency_ms").select("trace_id", line.alias("line"))


@Q("split_citations", f"SELECT DISTINCT form, rest FROM (SELECT string_split(x, ' ')[1] AS form, array_to_string(string_split(x, ' ')[2:], ' ') AS rest FROM (SELECT unnest(string_split(grounds, ', ')) AS x FROM {ATT('grounds')})) WHERE rest != ''")
def split_citations(spark: SparkSession, d: str) -> DataFrame:
    parts = attempts(spark, d, "grounds").select(F.explode(F.split("grounds", ", ")).alias("x")).select(tx.split_first(F.col("x"), " ").alias("s"))
    return parts.where("s.tail IS NOT NULL").select(F.col("s.head").alias("form"), F.col("s.tail").alias("rest")).distinct()


@Q("upserted_status", "SELECT claim_id, max(struct_pack(a := reported_at, b := coalesce(status, ''))).b AS status FROM claims GROUP BY claim_id")
def upserted_status(spark: SparkSession, d: str) -> DataFrame:
    """The claims of one line of business put over all others, the latest report per claim kept."""
    rows = table(spark, d, "claims").select("claim_id", "reported_at", F.coalesce("status", F.lit("")).alias("status"), F.coalesce(F.col("policy_line") == "homeowners", F.lit(False)).alias("home"))
    kept = relations.upsert(rows.where(~F.col("home")), rows.where("home"), ["claim_id"], [F.col("reported_at"), F.col("status")])
    return kept.select("claim_id", "status")
