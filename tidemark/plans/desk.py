"""The general problems of the claims desk: dangling references, nested records,
intervals, and attributes as known at event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import DASHES, OPEN_END, clean_key, day_number, day_text, form_part, instant, parse_day, strip, utc_day
from tidemark.operators.asof import asof_lookup
from tidemark.operators.intervals import merge_intervals
from tidemark.operators.joins import hot_values, salted_join
from tidemark.operators.references import find_orphans, orphan_counts, reference_targets
from tidemark.operators.shred import ancestor_table, flatten_leaf, leaf_levels
from tidemark.plans.registry import Registry
from tidemark.session import cut
from tidemark.sources.tables import table

REGISTRY = Registry()

RACE_LAPS = "run_id string, laps array<struct<tools: array<struct<tool: string>>>>"
TRAJ_CALLS = "claim_id string, tool_calls array<struct<args: string>>"
EVAL_CHECKS = "trace_id string, checks array<struct<name: string>>"
POLICY_TERMS = "policy_number string, terms array<struct<term_start: string, term_end: string, forms: array<string>>>, recorded_at timestamp"

# ---- SQL pieces shared by the oracles -------------------------------------------------

_KEY = rf"upper(regexp_replace(translate({{0}}, '{DASHES}', '{'-' * len(DASHES)}'), '^\s+|\s+$', '', 'g'))"


def _sql_key(c: str) -> str:
    return f"nullif({_KEY.format(c)}, '')"


def _sql_day(c: str) -> str:
    s = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    return (
        f"coalesce(try_cast(regexp_extract({s}, '^(\\d{{4}})[-/](\\d\\d)[-/](\\d\\d)(T.*)?$', 1) || '-' || "
        f"regexp_extract({s}, '^(\\d{{4}})[-/](\\d\\d)[-/](\\d\\d)(T.*)?$', 2) || '-' || "
        f"regexp_extract({s}, '^(\\d{{4}})[-/](\\d\\d)[-/](\\d\\d)(T.*)?$', 3) AS DATE), "
        f"CAST(try_strptime(CASE WHEN regexp_full_match({s}, '\\d{{8}}') THEN {s} END, '%Y%m%d') AS DATE), "
        f"CAST(try_strptime({s}, '%d %b %Y') AS DATE))"
    )


_TERMS_SQL = f"""terms_flat AS (
  SELECT policy_number, recorded_at, t.forms AS forms, {_sql_day("t.term_start")} AS s,
         CASE WHEN trim(coalesce(t.term_end, '')) = '' THEN DATE '{OPEN_END}' ELSE {_sql_day("t.term_end")} END AS e
  FROM (SELECT policy_number, recorded_at, unnest(terms) AS t FROM policies)),
terms_ok AS (SELECT * FROM terms_flat WHERE s IS NOT NULL AND e >= s AND policy_number IS NOT NULL)"""

# ---- 1. references -----------------------------------------------------------------------


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    attempts = table(spark, d, "suite_v2_attempt").select(
        F.lit("suite_v2_attempt").alias("src"),
        F.col("id").alias("rec_id"),
        F.lit("chunks").alias("target"),
        F.explode(F.transform("context_ids", clean_key)).alias("ref"),
        instant(F.col("ts")).alias("at"),
    )
    claims = table(spark, d, "claims").select(
        F.lit("claims").alias("src"),
        F.col("claim_id").alias("rec_id"),
        F.lit("policies").alias("target"),
        clean_key(F.col("policy_number")).alias("ref"),
        F.col("reported_at").alias("at"),
    )
    chunks = table(spark, d, "chunks").withColumn("key", clean_key(F.col("chunk_id")))
    policies = table(spark, d, "policies").withColumn("key", clean_key(F.col("policy_number")))
    targets = reference_targets(chunks, "chunks", "key", "ingested_at", "deleted_at").unionByName(
        reference_targets(policies, "policies", "key", "recorded_at", "deleted_at")
    )
    return attempts.unionByName(claims), targets


_ORPHANS_SQL = f"""
WITH targets AS (
  SELECT 'chunks' AS target, {_sql_key("chunk_id")} AS ref, min(ingested_at) AS first_at, min(deleted_at) AS gone_at FROM chunks GROUP BY ALL
  UNION ALL
  SELECT 'policies', {_sql_key("policy_number")}, min(recorded_at), min(deleted_at) FROM policies GROUP BY ALL),
refs AS (
  SELECT 'suite_v2_attempt' AS src, id AS rec_id, 'chunks' AS target, {_sql_key("c")} AS ref, CAST(ts AS TIMESTAMPTZ) AS seen
  FROM (SELECT id, ts, unnest(context_ids) AS c FROM suite_v2_attempt)
  UNION ALL
  SELECT 'claims', claim_id, 'policies', {_sql_key("policy_number")}, reported_at FROM claims),
judged AS (
  SELECT src, rec_id, r.ref, CASE WHEN t.ref IS NULL THEN 'missing' WHEN first_at > seen THEN 'late' WHEN gone_at <= seen THEN 'deleted' END AS kind,
         strftime(make_timestamp(CAST(epoch_us(seen) AS BIGINT)), '%Y-%m') AS period
  FROM refs r LEFT JOIN targets t ON t.target = r.target AND t.ref = r.ref WHERE r.ref IS NOT NULL),
orphans AS (SELECT DISTINCT src, rec_id, ref, kind, period FROM judged WHERE kind IS NOT NULL)
"""


@REGISTRY.add("p1_found", _ORPHANS_SQL + "SELECT * FROM orphans")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return find_orphans(*_references(spark, d))


@REGISTRY.add(
    "p1_counts",
    _ORPHANS_SQL
    + "SELECT src, period, kind, count(*) AS n_refs, count(DISTINCT rec_id) AS n_records, count(DISTINCT ref) AS n_keys FROM orphans GROUP BY ALL",
)
def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(find_orphans(*_references(spark, d)))


# ---- 3. nested records -------------------------------------------------------------------

_LEAVES = {
    "race_single": (RACE_LAPS, "run_id", "laps", ("[]", "tools", "[]", "tool")),
    "traj_before": (TRAJ_CALLS, "claim_id", "tool_calls", ("[]", "args", "{form_numbers}", "[]")),
    "eval_before": (EVAL_CHECKS, "trace_id", "checks", ("[]", "name")),
}


@REGISTRY.add(
    "p3_found",
    """
WITH race AS (
  SELECT run_id AS rec_id, i - 1 AS lvl1, j - 1 AS lvl2, laps[i].tools[j].tool AS val
  FROM (SELECT run_id, laps, i, unnest(range(1, len(laps[i].tools) + 1)) AS j
        FROM (SELECT run_id, laps, unnest(range(1, len(laps) + 1)) AS i FROM race_single))),
calls AS (SELECT claim_id, tool_calls[i].args AS args, i FROM (SELECT claim_id, tool_calls, unnest(range(1, len(tool_calls) + 1)) AS i FROM traj_before)),
docs AS (SELECT claim_id, i, CASE WHEN json_valid(args) THEN CASE WHEN json_type(args) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(args, '$')) THEN CAST(json_extract_string(args, '$') AS JSON) END ELSE CAST(args AS JSON) END END AS doc FROM calls),
forms AS (
  SELECT claim_id AS rec_id, i - 1 AS lvl1, 0 AS lvl2, json_extract_string(doc, '$.form_numbers') AS val FROM docs WHERE json_type(doc, '$.form_numbers') = 'VARCHAR'
  UNION ALL
  SELECT claim_id, i - 1, j - 1, json_extract_string(doc, '$.form_numbers[' || (j - 1) || ']')
  FROM (SELECT claim_id, i, doc, unnest(range(1, CAST(json_array_length(doc, '$.form_numbers') AS BIGINT) + 1)) AS j FROM docs WHERE json_type(doc, '$.form_numbers') = 'ARRAY')),
checked AS (SELECT trace_id AS rec_id, i - 1 AS lvl1, -1 AS lvl2, checks[i].name AS val FROM (SELECT trace_id, checks, unnest(range(1, len(checks) + 1)) AS i FROM eval_before))
SELECT DISTINCT src, rec_id, CAST(lvl1 AS INTEGER) AS lvl1, CAST(lvl2 AS INTEGER) AS lvl2, val FROM (
  SELECT 'race_single' AS src, * FROM race UNION ALL SELECT 'traj_before', * FROM forms UNION ALL SELECT 'eval_before', * FROM checked) WHERE val IS NOT NULL
""",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        flatten_leaf(table(spark, d, name, schema), key, column, path).select(F.lit(name).alias("src"), "rec_id", "lvl1", "lvl2", "val")
        for name, (schema, key, column, path) in _LEAVES.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@REGISTRY.add(
    "p3_levels",
    """
SELECT rep, depth, count(*) AS n FROM (
  SELECT CASE WHEN i > 1 AND j = 1 THEN 1 WHEN j > 1 THEN 2 ELSE 0 END AS rep,
         CASE WHEN laps IS NULL THEN 0 WHEN len(laps) = 0 THEN 1 WHEN laps[i] IS NULL THEN 2 WHEN laps[i].tools IS NULL THEN 3
              WHEN len(laps[i].tools) = 0 THEN 4 WHEN laps[i].tools[j] IS NULL THEN 5 WHEN laps[i].tools[j].tool IS NULL THEN 6 ELSE 7 END AS depth
  FROM (SELECT laps, i, unnest(range(1, greatest(1, coalesce(len(laps[i].tools), 0)) + 1)) AS j
        FROM (SELECT laps, unnest(range(1, greatest(1, coalesce(len(laps), 0)) + 1)) AS i FROM race_single))) GROUP BY ALL
""",
)
def p3_levels(spark: SparkSession, d: str) -> DataFrame:
    schema, key, column, path = _LEAVES["race_single"]
    return leaf_levels(table(spark, d, "race_single", schema), key, column, path).groupBy("rep", "depth").agg(F.count("*").alias("n"))


#: Tables of repeated ancestors: table, schema of what is read, key, column, path, leaves.
_LAP = {"lap": "int", "prompt_tokens": "int", "completion_tokens": "int", "call_s": "double", "wait_s": "double", "estimated": "boolean"}
_ANCESTORS = {
    "p3_laps": ("race_single", "run_id", "laps", ("[]",), _LAP, f"run_id string, laps array<struct<{', '.join(f'{n}: {k}' for n, k in _LAP.items())}>>"),
    "p3_tools": ("race_single", "run_id", "laps", ("[]", "tools", "[]"), {"tool": "string", "args": "string"}, "run_id string, laps array<struct<tools: array<struct<tool: string, args: string>>>>"),
    "p3_calls": ("traj_before", "claim_id", "tool_calls", ("[]",), {"tool": "string", "args": "string", "returned": "string"}, "claim_id string, tool_calls array<struct<tool: string, args: string, returned: string>>"),
    "p3_checks": ("eval_before", "trace_id", "checks", ("[]",), {"name": "string", "passed": "boolean", "detail": "string"}, "trace_id string, checks array<struct<name: string, passed: boolean, detail: string>>"),
}


def _ancestor_sql(name: str, key: str, column: str, path: tuple[str, ...], leaves: dict[str, str]) -> str:
    """Nested unnesting by place, one step a list."""
    source, item, at = f"SELECT {key} AS rec_id, {column} AS x FROM {name}", "x", []
    for step in path:
        if step == "[]":
            at.append(f"i{len(at) + 1}")
            source = f"SELECT rec_id, {''.join(f'{i}, ' for i in at[:-1])}x, unnest(range(1, len({item}) + 1)) AS {at[-1]} FROM ({source})"
            item = f"{item}[{at[-1]}]"
        else:
            item = f"{item}.{step}"
    cols = ", ".join([*(f"CAST({i} - 1 AS INTEGER) AS lvl{k + 1}" for k, i in enumerate(at)), *(f"{item}.{leaf} AS {leaf}" for leaf in leaves)])
    return f"SELECT DISTINCT rec_id, {cols} FROM ({source})"


def _ancestor(name: str):
    source, key, column, path, leaves, schema = _ANCESTORS[name]

    def plan(spark: SparkSession, d: str) -> DataFrame:
        return ancestor_table(table(spark, d, source, schema), key, column, path, leaves).distinct()

    return REGISTRY.add(name, _ancestor_sql(source, key, column, path, leaves))(plan)


for _name in _ANCESTORS:
    _ancestor(_name)


# ---- 4. intervals ------------------------------------------------------------------------


def policy_terms(spark: SparkSession, d: str) -> DataFrame:
    """One row per stored term: clean policy number, day numbers ``s`` and ``e``, forms, recording.

    A null or blank end is open; terms without a readable start or end, or ending before
    they start, are left out.
    """


    def read(t: Column) -> Column:
        open_ = F.coalesce(F.regexp_replace(t["term_end"], r"(?U)\s+", ""), F.lit("")) == ""
        end = F.when(open_, F.lit(OPEN_END).cast("date")).otherwise(parse_day(t["term_end"]))
        return F.struct(day_number(parse_day(t["term_start"])).alias("s"), day_number(end).alias("e"), t["forms"].alias("forms"))

    rows = table(spark, d, "policies", POLICY_TERMS).select(clean_key(F.col("policy_number")).alias("policy_number"), "recorded_at", F.transform("terms", read).alias("terms"))
    # the outer form, as else a filter would be inferred that reads every term once more
    kept = rows.select("policy_number", "recorded_at", F.filter("terms", lambda x: x["s"] <= x["e"]).alias("terms"))
    return kept.select("policy_number", "recorded_at", F.expr("inline_outer(terms)")).where("s IS NOT NULL")


@REGISTRY.add(
    "p4_found",
    f"""
WITH {_TERMS_SQL},
marked AS (SELECT policy_number, s, e, max(e) OVER (PARTITION BY policy_number ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT policy_number, s, e FROM terms_ok)),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR date_diff('day', before, s) > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY policy_number ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
periods AS (SELECT policy_number, island, min(s) AS a, max(e) AS b FROM numbered GROUP BY ALL)
SELECT policy_number, 'period' AS kind, strftime(a, '%Y-%m-%d') AS start_date, strftime(b, '%Y-%m-%d') AS end_date FROM periods
UNION ALL
SELECT policy_number, 'gap', strftime(CAST(b + INTERVAL 1 DAY AS DATE), '%Y-%m-%d'), strftime(CAST(nxt - INTERVAL 1 DAY AS DATE), '%Y-%m-%d')
FROM (SELECT policy_number, b, lead(a) OVER (PARTITION BY policy_number ORDER BY a) AS nxt FROM periods) WHERE nxt IS NOT NULL
""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return merge_intervals(policy_terms(spark, d), "policy_number", "s", "e").select(
        F.col("entity").alias("policy_number"), "kind", day_text(F.col("first")).alias("start_date"), day_text(F.col("last")).alias("end_date")
    )


# ---- 6. as known at event time -----------------------------------------------------------


@REGISTRY.add(
    "p6_found",
    f"""
WITH {_TERMS_SQL},
lost AS (SELECT DISTINCT claim_id, {_sql_key("policy_number")} AS policy_number, {_sql_day("date_of_loss")} AS d FROM claims),
term AS (
  SELECT claim_id, d, s, forms FROM lost l JOIN terms_ok t ON t.policy_number = l.policy_number
    AND d BETWEEN s AND e AND CAST(make_timestamp(CAST(epoch_us(recorded_at) AS BIGINT)) AS DATE) <= d
  QUALIFY row_number() OVER (PARTITION BY claim_id, l.policy_number, d ORDER BY s DESC, recorded_at DESC) = 1),
held AS (SELECT DISTINCT claim_id, d, s, nullif(regexp_replace({_KEY.format("f")}, '\\s+ED\\b.*$', ''), '') AS form FROM (SELECT claim_id, d, s, unnest(forms) AS f FROM term)),
editions AS (
  SELECT {_sql_key("form_number")} AS form, edition, max({_sql_day("edition_date")}) AS edition_date,
         CAST(make_timestamp(CAST(epoch_us(min(ingested_at)) AS BIGINT)) AS DATE) AS known FROM chunks GROUP BY 1, 2),
best AS (
  SELECT claim_id, s, h.form, edition FROM held h JOIN editions x ON x.form = h.form AND edition_date <= d AND known <= d
  QUALIFY row_number() OVER (PARTITION BY claim_id, d, s, h.form ORDER BY edition_date DESC, edition DESC) = 1)
SELECT DISTINCT claim_id, strftime(s, '%Y-%m-%d') AS term_start, form AS form_number, edition FROM best
""",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Term and form editions of each claim as valid and on record on the day of loss."""
    lost = cut(
        table(spark, d, "claims")
        .select("claim_id", clean_key(F.col("policy_number")).alias("policy"), day_number(parse_day(F.col("date_of_loss"))).alias("day"))
        .where(F.col("policy").isNotNull() & F.col("day").isNotNull())
        .distinct()
    )
    terms = policy_terms(spark, d).select(
        F.col("policy_number").alias("entity"),
        F.col("s").alias("start"),
        F.when(F.col("e") < F.lit(day_number(F.lit(OPEN_END).cast("date"))), F.col("e")).alias("end"),
        utc_day(F.col("recorded_at")).alias("known"),
        F.unix_micros("recorded_at").alias("rank"),
        F.col("s").alias("term_start"),
        "forms",
    )
    held = cut(
        asof_lookup(lost.select(F.col("policy").alias("entity"), F.col("day").alias("at")), terms, ["term_start", "forms"])
        .select(F.col("entity").alias("policy"), F.col("at").alias("day"), "term_start", F.explode(F.transform("forms", form_part)).alias("form"))
        .where(F.col("form").isNotNull())
        .distinct()
    )
    editions = (
        table(spark, d, "chunks")
        .groupBy(clean_key(F.col("form_number")).alias("entity"), "edition")
        .agg(day_number(F.max(parse_day(F.col("edition_date")))).alias("start"), utc_day(F.min("ingested_at")).alias("known"))
        .select("entity", "start", F.lit(None).cast("int").alias("end"), "known", F.lit(0).cast("long").alias("rank"), "edition")
    )
    found = asof_lookup(held.select(F.col("form").alias("entity"), F.col("day").alias("at")), editions, ["edition"])
    found = found.select(F.col("entity").alias("form"), F.col("at").alias("day"), "edition")
    chosen = salted_join(held, found, ["form", "day"], hot_values(held, "form"), F.col("policy"))
    return (
        salted_join(lost, chosen, ["policy", "day"], hot_values(lost, "policy"), F.col("claim_id"))
        .select("claim_id", day_text(F.col("term_start")).alias("term_start"), F.col("form").alias("form_number"), "edition")
        .distinct()
    )
