"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.mixing import clean_source, mix_sources, reached_shares
from tidemark.llm.pii import find_personal_data, redact_personal_data
from tidemark.llm.quantiles import build_sketch, merge_sketches, sketch_percentiles
from tidemark.llm.subjects import subject_areas, train_from_tables
from tidemark.llm.tokens import decode_corpus, encode_corpus, pieces, read_ranks, with_token_counts
from tidemark.plans.registry import Registry
from tidemark.sources.tables import table

REGISTRY = Registry()

# ---- 2. percentiles ----------------------------------------------------------------------

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """``(run_id, month, arm, field, value)``: each run once, null and NaN measurements left out."""
    runs = table(spark, d, "race_single").select("run_id", F.substring("ts", 1, 7).alias("month"), "arm", "latency_s", "cost_usd").dropDuplicates(["run_id"])
    long = runs.unpivot(["run_id", "month", "arm"], ["latency_s", "cost_usd"], "field", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


@REGISTRY.add("p2_percentiles")
def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of both measurements per arm, each within ``rank_error`` of its rank."""
    return sketch_percentiles(build_sketch(measurements(spark, d), ["arm", "field"], "value"), QUANTILES)


@REGISTRY.add("p2_merged")
def p2_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same from one sketch per month, put together by addition."""
    monthly = build_sketch(measurements(spark, d), ["month", "arm", "field"], "value")
    return sketch_percentiles(merge_sketches(monthly.drop("month")), QUANTILES)


@REGISTRY.add(
    "p2_rank_check",
    f"""
WITH runs AS (SELECT DISTINCT run_id, arm, latency_s, cost_usd FROM race_single),
long AS (SELECT arm, 'latency_s' AS field, latency_s AS value FROM runs UNION ALL SELECT arm, 'cost_usd', cost_usd FROM runs),
sizes AS (SELECT arm, field, count(*) AS n FROM long WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL)
SELECT arm, field, q, n, true AS within_bound FROM sizes, (SELECT unnest([{", ".join(f"CAST({q} AS DOUBLE)" for q in QUANTILES)}]) AS q)
""",
)
def p2_rank_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether each percentile's rank in the data is within the stated bound of the one asked for."""
    data = measurements(spark, d)
    found = sketch_percentiles(build_sketch(data, ["arm", "field"], "value"), QUANTILES).withColumnRenamed("value", "found")
    near = F.abs(F.col("found")) * 2.0**-20
    ranked = (
        data.alias("v").join(F.broadcast(found).alias("f"), F.col("v.arm").eqNullSafe(F.col("f.arm")) & (F.col("v.field") == F.col("f.field")))  # 8 rows a group
        .groupBy("f.arm", "f.field", "q", "n", "rank_error")
        .agg(F.count_if(F.col("value") < F.col("found") - near).alias("below"), F.count_if(F.col("value") <= F.col("found") + near).alias("upto"))
    )
    want, slack = F.ceil(F.col("q") * F.col("n")), F.col("rank_error") * F.col("n") + 1
    return ranked.select("arm", "field", "q", "n", ((F.col("below") - slack <= want) & (F.col("upto") + slack >= want)).alias("within_bound"))


# ---- 5. personal data --------------------------------------------------------------------


def desk_texts(spark: SparkSession, d: str) -> DataFrame:
    """``(src, rec_id, field, pos, text)``: every distinct free text of the desk with its place."""
    claims = table(spark, d, "claims")
    notice = claims.select(F.lit("claims").alias("src"), F.col("claim_id").alias("rec_id"), F.lit("first_notice").alias("field"), F.lit(0).alias("pos"), F.col("first_notice").alias("text"))
    notes = claims.select(F.lit("claims").alias("src"), F.col("claim_id").alias("rec_id"), F.lit("adjuster_notes").alias("field"), F.posexplode("adjuster_notes").alias("pos", "text"))
    asked = table(spark, d, "demo").select(F.lit("demo").alias("src"), F.col("trace_id").alias("rec_id"), F.lit("question").alias("field"), F.lit(0).alias("pos"), F.col("question").alias("text"))
    return notice.unionByName(notes).unionByName(asked).where("text IS NOT NULL AND text != ''")


@REGISTRY.add("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    keep = ["src", "rec_id", "field", "pos"]
    return find_personal_data(desk_texts(spark, d), "text", keep).select(*keep, "kind", "item").distinct()


@REGISTRY.add("p5_redacted")
def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact_personal_data(desk_texts(spark, d).distinct(), "text")


# ---- 7. tokens ---------------------------------------------------------------------------


@REGISTRY.add("p7_ids")
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text", read_ranks())


@REGISTRY.add("p7_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts back from their ids."""
    ranks = read_ranks()
    return decode_corpus(encode_corpus(table(spark, d, "documents"), "doc_id", "text", ranks), "doc_id", pieces(spark, ranks))


# ---- 8. mixture --------------------------------------------------------------------------


def _mixture(spark: SparkSession, d: str):
    docs = with_token_counts(table(spark, d, "documents"), "text", read_ranks()).select("doc_id", clean_source(F.col("source")).alias("source"), "tokens")
    targets = table(spark, d, "mix_targets").select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    return mix_sources(docs, targets)


@REGISTRY.add("p8_mix")
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


@REGISTRY.add("p8_shares")
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return reached_shares(*_mixture(spark, d))


# ---- 9. subject areas --------------------------------------------------------------------


def _areas(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text", "source", "form_number")
    model = train_from_tables(documents, table(spark, d, "subject_labels"), table(spark, d, "subjects"), ["source", "form_number"])
    return subject_areas(documents.select("doc_id", "text"), model)


@REGISTRY.add("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _areas(spark, d).select("doc_id", "subject").distinct()


@REGISTRY.add("p9_composition")
def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters of the corpus by subject area."""
    sizes = table(spark, d, "documents").select("doc_id", F.length("text").alias("chars"))
    return _areas(spark, d).join(sizes, "doc_id").groupBy("subject").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"))
