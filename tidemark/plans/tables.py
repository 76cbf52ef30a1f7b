"""Joins, set operations and windows over the desk's and the star tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import clean_key, day_number, day_text, parse_day
from tidemark.operators import relations
from tidemark.plans.desk import _KEY, _TERMS_SQL, _sql_day, _sql_key, policy_terms
from tidemark.plans.registry import Registry
from tidemark.plans.runs import EVAL, RACE, TRAJ, evals, races, trajectories
from tidemark.session import cut
from tidemark.sources.tables import table
from tidemark.streaming import streams

REGISTRY = Registry()
Q = REGISTRY.add

# ---- policies and claims ------------------------------------------------------------------

_LOST = f"(SELECT DISTINCT claim_id, {_sql_key('policy_number')} AS policy_number, {_sql_day('date_of_loss')} AS d FROM claims)"


def _lost(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims").select("claim_id", clean_key(F.col("policy_number")).alias("policy"), day_number(parse_day(F.col("date_of_loss"))).alias("day")).distinct()


@Q("range_join", f"""
WITH {_TERMS_SQL}, t AS (SELECT DISTINCT policy_number, s, e FROM terms_ok)
SELECT claim_id, l.policy_number AS policy, strftime(min(s), '%Y-%m-%d') AS term_start FROM {_LOST} l LEFT JOIN t ON t.policy_number = l.policy_number AND d BETWEEN s AND e GROUP BY claim_id, l.policy_number, d""")  # fmt: skip
def range_join(spark: SparkSession, d: str) -> DataFrame:
    """The first term that covers the loss; claims without one stay."""
    terms = policy_terms(spark, d).select(F.col("policy_number").alias("policy"), "s", "e").distinct()
    found = relations.covering_interval(_lost(spark, d), terms, "policy", "day", "s", "e", ["s", "e"], ["s"])
    return found.select("claim_id", "policy", day_text(F.col("s")).alias("term_start"))


@Q("coverage_status", f"""
WITH {_TERMS_SQL}, t AS (SELECT DISTINCT policy_number, s, e FROM terms_ok),
j AS (SELECT claim_id, l.policy_number, d, count(*) FILTER (d BETWEEN s AND e) AS hits, count(s) AS on_record FROM {_LOST} l LEFT JOIN t ON t.policy_number = l.policy_number GROUP BY ALL)
SELECT CASE WHEN d IS NULL THEN 'NO_DATE' WHEN on_record = 0 THEN 'NO_POLICY' WHEN hits > 0 THEN 'IN_FORCE' ELSE 'NOT_IN_FORCE' END AS status, count(*) AS n FROM j GROUP BY 1""")  # fmt: skip
def coverage_status(spark: SparkSession, d: str) -> DataFrame:
    terms = policy_terms(spark, d).select(F.col("policy_number").alias("policy"), "s", "e").distinct()
    hit = F.col("day").between(F.col("s"), F.col("e"))
    found = _lost(spark, d).join(terms, "policy", "left").groupBy("claim_id", "policy", "day").agg(F.count_if(hit).alias("hits"), F.count("s").alias("on_record"))
    status = F.when(F.col("day").isNull(), "NO_DATE").when(F.col("on_record") == 0, "NO_POLICY").when(F.col("hits") > 0, "IN_FORCE").otherwise("NOT_IN_FORCE")
    return found.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@Q("asof_edition", f"""
WITH a AS (SELECT DISTINCT claim_id, regexp_extract({_KEY.format('f')}, '^[A-Z]{{2}}-\\d{{4}}') AS form, d FROM (SELECT claim_id, unnest(forms_attached) AS f, {_sql_day('date_of_loss')} AS d FROM claims)),
e AS (SELECT form_number AS form, edition, min(in_force_from) AS f, max(in_force_to) AS t FROM chunks GROUP BY ALL)
SELECT claim_id, a.form, max(edition) AS edition FROM a JOIN e ON a.form = e.form AND CAST(strftime(d, '%Y%m%d') AS INTEGER) BETWEEN f AND t GROUP BY claim_id, a.form, d""")  # fmt: skip
def asof_edition(spark: SparkSession, d: str) -> DataFrame:
    """The edition of each attached form in force on the day of loss, by the library's own windows."""
    claims = table(spark, d, "claims").select("claim_id", F.date_format(parse_day(F.col("date_of_loss")), "yyyyMMdd").cast("int").alias("day"), F.explode(F.transform("forms_attached", clean_key)).alias("f"))
    attached = claims.select("claim_id", "day", F.regexp_extract("f", r"^[A-Z]{2}-\d{4}", 0).alias("form")).distinct()
    editions = table(spark, d, "chunks").groupBy(F.col("form_number").alias("form"), "edition").agg(F.min("in_force_from").alias("a"), F.max("in_force_to").alias("b"))
    held = attached.join(editions, (attached["form"] == editions["form"]) & F.col("day").between(F.col("a"), F.col("b")))
    return held.groupBy("claim_id", attached["form"], "day").agg(F.max("edition").alias("edition")).select("claim_id", "form", "edition")


@Q("repeated_claims", "SELECT claim_id, count(*) AS n FROM claims GROUP BY claim_id HAVING count(*) > 1")
def repeated_claims(spark: SparkSession, d: str) -> DataFrame:
    return relations.repeated_keys(table(spark, d, "claims"), ["claim_id"])


@Q("pending_items", "SELECT DISTINCT claim_id FROM claims WHERE claim_id NOT IN (SELECT id FROM eval_before WHERE id IS NOT NULL)")
def pending_items(spark: SparkSession, d: str) -> DataFrame:
    done = evals(spark, d, "id").select(F.col("id").alias("claim_id"))
    return relations.pending(table(spark, d, "claims").select("claim_id").distinct(), done, "claim_id")


@Q("complete_join", f"SELECT trace_id, e.id, q.n FROM {EVAL('id')} e JOIN (SELECT id, count(*) AS n FROM {EVAL('id')} GROUP BY id) q ON e.id = q.id")
def complete_join(spark: SparkSession, d: str) -> DataFrame:
    """Every graded run with the size of its case; a case without a partner would be an error."""
    runs = evals(spark, d, "id")
    return relations.complete_join(runs, runs.groupBy("id").agg(F.count("*").alias("n")), "id").select("trace_id", "id", "n")


@Q("first_available", f"""
WITH e AS (SELECT id, max(judge) AS v FROM {EVAL('id, judge')} GROUP BY id), t AS (SELECT claim_id, class AS v FROM {TRAJ('class')}), c AS (SELECT claim_id, max(status) AS v FROM claims GROUP BY claim_id)
SELECT c.claim_id, coalesce(t.v, e.v, c.v) AS v, CASE WHEN t.v IS NOT NULL THEN 2 WHEN e.v IS NOT NULL THEN 1 WHEN c.v IS NOT NULL THEN 0 END AS source FROM c LEFT JOIN e ON e.id = c.claim_id LEFT JOIN t ON t.claim_id = c.claim_id""")  # fmt: skip
def first_available(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "claims").groupBy("claim_id").agg(F.max("status").alias("v"))
    graded = evals(spark, d, "id", "judge").groupBy(F.col("id").alias("claim_id")).agg(F.max("judge").alias("v"))
    return relations.first_available("claim_id", "v", base, graded, trajectories(spark, d, "class").withColumnRenamed("class", "v"))


@Q("argument_lookup", f"""
WITH a AS (SELECT claim_id, tool_calls[i].tool AS tool, CASE WHEN json_valid(tool_calls[i].args) THEN json_extract_string(tool_calls[i].args, '$.claim_id') END AS ref FROM (SELECT claim_id, tool_calls, unnest(range(1, len(tool_calls) + 1)) AS i FROM {TRAJ('tool_calls')}))
SELECT tool, CASE WHEN NOT coalesce(regexp_full_match(ref, 'CLM-\\d{{4}}-\\d{{8}}'), false) THEN 'malformed' WHEN ref NOT IN (SELECT claim_id FROM claims) THEN 'not found' ELSE 'ok' END AS status, count(*) AS n FROM a WHERE tool IS NOT NULL GROUP BY ALL""")  # fmt: skip
def argument_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Claim numbers in tool arguments: malformed or absent, not found, or on file."""
    calls = trajectories(spark, d, "tool_calls").select(F.explode("tool_calls").alias("c")).where("c.tool IS NOT NULL")
    ref = F.try_variant_get(F.try_parse_json("c.args"), "$.claim_id", "string")
    asked = calls.select(F.col("c.tool").alias("tool"), ref.alias("claim_id"))
    return relations.lookup_status(asked, table(spark, d, "claims"), "claim_id", r"^CLM-\d{4}-\d{8}$").groupBy("tool", "status").agg(F.count("*").alias("n"))


@Q("suite_union", f"SELECT source, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT 'eval' AS source, id FROM {EVAL('id')} UNION ALL SELECT 'race', id FROM {RACE('id')} UNION ALL SELECT 'trajectory', claim_id FROM {TRAJ('class')}) GROUP BY source")
def suite_union(spark: SparkSession, d: str) -> DataFrame:
    parts = {"eval": evals(spark, d, "id"), "race": races(spark, d, "id"), "trajectory": trajectories(spark, d).select(F.col("claim_id").alias("id"))}
    frames = [df.select(F.lit(name).alias("source"), "id") for name, df in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@Q("both_and_neither", f"SELECT (SELECT count(*) FROM (SELECT id FROM eval_before INTERSECT SELECT claim_id FROM traj_before)) AS both_n, (SELECT count(*) FROM (SELECT id FROM eval_before EXCEPT SELECT claim_id FROM traj_before)) AS eval_only, (SELECT count(*) FROM (SELECT claim_id FROM traj_before EXCEPT SELECT id FROM eval_before)) AS traj_only")
def both_and_neither(spark: SparkSession, d: str) -> DataFrame:
    a = evals(spark, d, "id").select("id").distinct().withColumn("a", F.lit(True))
    b = trajectories(spark, d).select(F.col("claim_id").alias("id"), F.lit(True).alias("b"))
    return a.join(b, "id", "full").agg(F.count_if(F.col("a") & F.col("b")).alias("both_n"), F.count_if(F.col("b").isNull()).alias("eval_only"), F.count_if(F.col("a").isNull()).alias("traj_only"))


@Q("tool_words", "WITH t AS (SELECT unnest(['get_claim', 'policy_lookup', 'search_policy', 'compute_payout']) AS x) SELECT a.x || ' ' || b.x || ' ' || c.x AS path FROM t a, t b, t c UNION ALL SELECT a.x || ' ' || b.x FROM t a, t b")
def tool_words(spark: SparkSession, d: str) -> DataFrame:
    """All call sequences of two and three steps over four tools; a fixed dimension table."""
    tools = F.array(*map(F.lit, ("get_claim", "policy_lookup", "search_policy", "compute_payout")))
    step = lambda df: df.withColumn("t", F.explode(tools)).select(F.concat_ws(" ", "path", "t").alias("path"))
    one = spark.range(1).select(F.explode(tools).alias("path"))
    two = step(one)
    return two.unionByName(step(two))


# ---- star tables --------------------------------------------------------------------------


@Q("order_totals", "SELECT o_orderpriority, count(*) AS orders, CAST(sum(n) AS BIGINT) AS lines, round(sum(net), 2) AS net FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS net FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def order_totals(spark: SparkSession, d: str) -> DataFrame:
    """Parents with rolled-up children: lines are reduced per order before the join."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    joined = table(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.sum("n").alias("lines"), F.round(F.sum("net"), 2).alias("net"))


@Q("nation_segments", "SELECT r_name, n_name, c_mktsegment, count(*) AS customers, round(avg(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def nation_segments(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("s"))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return per.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "c_mktsegment", "customers", F.round(F.col("s") / F.col("customers"), 4).alias("balance"))


@Q("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("net"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


@Q("json_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


# ---- event time ---------------------------------------------------------------------------

_US = "make_timestamp((epoch_us(ts) // {0}) * {0})"


@Q("tumbling_counts", f"SELECT {_US.format(3600_000_000)} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@Q("session_spans", """
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us FROM s GROUP BY user_id, k""")  # fmt: skip
def session_spans(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = events.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.unix_micros(F.max("ts")).alias("b"), F.unix_micros(F.min("ts")).alias("a"))
    return found.select("user_id", "n", (F.col("b") - F.col("a")).alias("span_us"))


def _stream(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The events as a stream, and a fresh folder in the shared storage for its output."""
    cut(spark.range(1))  # makes sure there is a checkpoint folder
    static = table(spark, d, "events")
    # a pattern, since a stream's plain path must be a folder
    stream = streams.parquet_stream(spark, f"{d}/events.parque[t]", static.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return stream, f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


@Q("stream_day_roll", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def stream_day_roll(spark: SparkSession, d: str) -> DataFrame:
    """The stream written to one folder a day, then read back."""
    stream, out = _stream(spark, d)
    streams.run_available(stream.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), f"{out}/log", f"{out}/state", partition=["day"])
    return spark.read.parquet(f"{out}/log").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@Q("stream_once", "SELECT user_id, count(DISTINCT event_id) AS n FROM events GROUP BY user_id")
def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """Events delivered twice, kept once per id."""
    stream, out = _stream(spark, d)
    again = stream.unionByName(_stream(spark, d)[0])
    streams.run_available(streams.once_per_key(again, "ts", "event_id", "3650 days").select("user_id", "event_id"), f"{out}/log", f"{out}/state")
    return spark.read.parquet(f"{out}/log").groupBy("user_id").agg(F.count("*").alias("n"))


@Q("stream_budget", "SELECT user_id, count(*) AS n FROM (SELECT user_id, sum(value) OVER (PARTITION BY user_id) AS s FROM events) WHERE s >= 1000 GROUP BY user_id")
def stream_budget(spark: SparkSession, d: str) -> DataFrame:
    stream, out = _stream(spark, d)
    streams.run_available(streams.budget_stops(stream.select("user_id", "value"), "user_id", "value", 1000.0), f"{out}/log", f"{out}/state")
    return spark.read.parquet(f"{out}/log").select("user_id", "n")
