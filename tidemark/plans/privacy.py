"""Redaction queries: rule sets, names outside the wording, scrubbed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import redaction as rd
from tidemark.plans.registry import Registry
from tidemark.plans.runs import DEMO, TRAJ, demos, trajectories
from tidemark.sources.tables import table

REGISTRY = Registry()
Q = REGISTRY.add

#: DuckDB's word ends are ASCII only: its queries write an accented letter as its number
#: between underscores, which are word characters but no letters, and put it back at the end.
_ACCENTED = [chr(i) for i in range(0xC0, 0x180) if chr(i).isalpha()]


def _ascii(c: str, back: bool = False) -> str:
    for x in _ACCENTED:
        c = f"replace({c}, '_{ord(x)}_', '{x}')" if back else f"replace({c}, '{x}', '_{ord(x)}_')"
    return c


CLAIMS = "(SELECT claim_id, " + _ascii("first(first_notice)") + " AS first_notice, list_transform(first(adjuster_notes), lambda n: " + _ascii("n") + ") AS adjuster_notes FROM claims GROUP BY claim_id)"
_VOCABULARY = f"voc AS (SELECT list_distinct(list(w) || {rd.STOP}) AS v FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS w FROM chunks))"
_KNOWN = r"list_has_any(list_transform(string_split_regex({0}, '\s+'), lambda w: lower(trim(w, '.'))), v)"


def _tokens_sql(c: str) -> str:
    found = f"list_filter(regexp_extract_all({c}, '{rd.TITLED[1]}') || regexp_extract_all({c}, '{rd.PAIR[1]}'), lambda m: NOT {_KNOWN.format('m')})"
    words = rf"flatten(list_transform({found}, lambda m: list_transform(string_split_regex(m, '\s+'), lambda w: trim(w, '.'))))"
    return f"coalesce(list_sort(list_distinct(list_filter({words}, lambda w: length(w) > 2 AND NOT list_contains(v || {rd.NAME_TITLES}, lower(w))))), [])"


def _redact_sql(source: str, rules: tuple[tuple[str, str], ...], sweep: bool = True) -> str:
    """Steps as named queries over ``source(k, t, v, words)``; the last is ``done(k, t)``."""
    steps, last = [], source
    for i, (label, pattern) in enumerate(rules):
        name = f"s{i}"
        if label == "NAME":
            pieces, found = f"string_split_regex(t, '{pattern}')", f"regexp_extract_all(t, '{pattern}')"
            text = f"CASE WHEN t IS NULL THEN NULL ELSE array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i > len(f) THEN '' WHEN {_KNOWN.format('f[i]')} THEN f[i] ELSE '[NAME]' END), '') END"
            steps.append(f"{name} AS MATERIALIZED (SELECT k, {text} AS t, v, words FROM (SELECT k, t, {pieces} AS p, {found} AS f, v, words FROM {last}))")
        else:
            steps.append(f"{name} AS MATERIALIZED (SELECT k, regexp_replace(t, '{pattern}', '[{label}]', 'g') AS t, v, words FROM {last})")
        last = name
    swept = r"CASE WHEN len(words) > 0 THEN regexp_replace(t, '\b(?:' || array_to_string(words, '|') || ')\b', '[NAME]', 'g') ELSE t END" if sweep else "t"
    return ", ".join([*steps, f"swept AS MATERIALIZED (SELECT k, {swept} AS t FROM {last})", f"done AS (SELECT k, {_ascii('t', True)} AS t FROM swept)"])


def _rules(spark: SparkSession, d: str, health: bool = False, claims: bool = False) -> rd.Rules:
    words = rd.wording_vocabulary(table(spark, d, "chunks"), "text")
    return rd.with_claim_ids(words) if claims else rd.keeping_claim_ids(words, health)


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims").select("claim_id", "first_notice", "adjuster_notes").dropDuplicates(["claim_id"])


_V1 = rd.with_claim_ids(()).ordered
_V2 = rd.keeping_claim_ids((), True).ordered


@Q("name_words", f"WITH {_VOCABULARY} SELECT claim_id, array_to_string({_tokens_sql('first_notice')}, ' ') AS words FROM {CLAIMS}, voc")
def name_words(spark: SparkSession, d: str) -> DataFrame:
    """The words of the names in each first notice that the wording does not know."""
    known = _rules(spark, d).vocabulary
    return _claims(spark, d).select("claim_id", F.array_join(rd.name_tokens(F.col("first_notice"), known), " ").alias("words"))


@Q("redact_first_rules", f"WITH {_VOCABULARY}, src AS (SELECT trace_id AS k, {_ascii('question')} AS t, v, [] AS words FROM {DEMO('question')}, voc), {_redact_sql('src', _V1, False)} SELECT k AS trace_id, t AS question FROM done")
def redact_first_rules(spark: SparkSession, d: str) -> DataFrame:
    """Questions under the rules that take claim numbers out, too."""
    return demos(spark, d, "question").select("trace_id", rd.redact_text(F.col("question"), _rules(spark, d, claims=True)).alias("question"))


@Q("redact_health", f"WITH {_VOCABULARY}, src AS (SELECT claim_id AS k, first_notice AS t, v, [] AS words FROM {CLAIMS}, voc), {_redact_sql('src', _V2, False)} SELECT k AS claim_id, t AS first_notice FROM done")
def redact_health(spark: SparkSession, d: str) -> DataFrame:
    """First notices with claim numbers kept and sentences on injuries taken out."""
    return _claims(spark, d).select("claim_id", rd.redact_text(F.col("first_notice"), _rules(spark, d, True)).alias("first_notice"))


_RECORD = (
    f"WITH {_VOCABULARY}, rec AS (SELECT claim_id, first_notice, adjuster_notes, v, list_sort(list_distinct({_tokens_sql('first_notice')} || coalesce(flatten(list_transform(adjuster_notes, lambda n: {_tokens_sql('n')})), []))) AS words FROM {CLAIMS}, voc), "
    "src AS (SELECT (claim_id, 0) AS k, first_notice AS t, v, words FROM rec UNION ALL SELECT (claim_id, i), adjuster_notes[i], v, words FROM (SELECT *, unnest(range(1, len(adjuster_notes) + 1)) AS i FROM rec)), "
    + _redact_sql("src", _V2)
)
_SCRUBBED = _RECORD + " SELECT k[1] AS claim_id, CAST(k[2] AS INTEGER) AS pos, t AS text FROM done"


@Q("scrub_records", _SCRUBBED)
def scrub_records(spark: SparkSession, d: str) -> DataFrame:
    """First notice (place 0) and notes (from 1) scrubbed together: a name of one goes from all."""
    done = rd.scrub(_claims(spark, d), ["first_notice", "adjuster_notes"], _rules(spark, d, True))
    first = done.select("claim_id", F.lit(0).alias("pos"), F.col("first_notice").alias("text"))
    return first.unionByName(done.select("claim_id", F.posexplode("adjuster_notes").alias("pos", "text")).withColumn("pos", F.col("pos") + 1))


@Q("scrub_leaks", _RECORD + rf" SELECT count(*) AS texts, count(*) FILTER (regexp_matches(t, '{rd.EMAIL[1]}') OR regexp_matches(t, '{rd.PHONE[1]}')) AS leaks FROM done WHERE t IS NOT NULL")
def scrub_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the scrubbed records that still hold an identifier."""
    rules = _rules(spark, d, True)
    done = rd.scrub(_claims(spark, d), ["first_notice", "adjuster_notes"], rules)
    texts = done.select("name_words", F.explode(F.concat(F.array("first_notice"), F.coalesce("adjuster_notes", F.array().cast("array<string>")))).alias("t")).where("t IS NOT NULL")
    return texts.agg(F.count("*").alias("texts"), F.count_if(~rd.is_clean(F.col("t"), rules, F.col("name_words"))).alias("leaks"))


_NESTED = f"""WITH {_VOCABULARY}, rec AS (SELECT claim_id, output, {_ascii('output.reasoning')} AS reasoning, v, list_sort(list_distinct(flatten(list_transform(list_filter([output.claim_id, output.coverage_position, output.reasoning, output.next_step] || coalesce(output.grounds, []), lambda s: s IS NOT NULL), lambda s: {_tokens_sql(_ascii('s'))})))) AS words
FROM {TRAJ('output').replace('any_value(output)', 'first(output)')}, voc), src AS (SELECT claim_id AS k, reasoning AS t, v, coalesce(words, []) AS words FROM rec), {_redact_sql('src', _V2)} SELECT k AS claim_id, t AS reasoning FROM done"""


@Q("scrub_nested", _NESTED)
def scrub_nested(spark: SparkSession, d: str) -> DataFrame:
    """A nested answer scrubbed with every string in it; its reasoning is shown."""
    done = rd.scrub(trajectories(spark, d, "output"), ["output"], _rules(spark, d, True))
    return done.select("claim_id", F.col("output.reasoning").alias("reasoning"))


@Q("redaction_labels", f"WITH {_VOCABULARY}, src AS (SELECT trace_id AS k, {_ascii('question')} AS t, v, [] AS words FROM {DEMO('question')}, voc), {_redact_sql('src', _V1, False)} SELECT x AS label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT x, len(regexp_extract_all(d.t, '\\[' || x || '\\]')) - len(regexp_extract_all(s.t, '\\[' || x || '\\]')) AS n FROM done d JOIN src s ON s.k = d.k, (SELECT unnest({sorted({x for x, _ in _V1})}) AS x)) WHERE n > 0 GROUP BY x")
def redaction_labels(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule took something out of a question."""
    rules = _rules(spark, d, claims=True)
    found = rd.label_counts(rd.redact_text(F.col("question"), rules), sorted({x for x, _ in rules.ordered}), F.col("question"))
    return demos(spark, d, "question").select(F.explode(found).alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n"))
