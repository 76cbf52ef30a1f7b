"""Retrieval, chunking and text queries over the wording library and the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.keys import clean_key
from tidemark.operators import chunking, rates, relations, retrieval
from tidemark.plans.registry import Registry
from tidemark.plans.runs import ATT, DEMO, attempts, demos
from tidemark.session import cut
from tidemark.sources.tables import table

REGISTRY = Registry()
Q = REGISTRY.add

CHUNKS = "(SELECT chunk_id, any_value(text) AS text, any_value(form_number) AS form_number, any_value(policy_line) AS policy_line, any_value(edition) AS edition, any_value(source_file) AS source_file FROM chunks GROUP BY chunk_id)"


def chunks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", *cols).dropDuplicates(["chunk_id"])


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every trace whose id is divisible by 20."""
    number = F.conv(F.substring("trace_id", 5, 12), 16, 10).cast("long")
    return demos(spark, d, "question").where("question IS NOT NULL AND question != ''").where(F.pmod(number, F.lit(20)) == 0)


ASKED = f"(SELECT trace_id, question FROM {DEMO('question')} WHERE question != '' AND CAST('0x' || substr(trace_id, 5, 12) AS BIGINT) % 20 = 0)"
_TOK = "regexp_extract_all(lower({0}), '[a-z0-9\\-]+')"
_TRIM = "regexp_replace({0}, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g')"

# ---- lexical ------------------------------------------------------------------------------

_BM25 = f"""
c AS MATERIALIZED (SELECT chunk_id, {_TOK.format('text')} AS w FROM {CHUNKS}),
p AS MATERIALIZED (SELECT term, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM c) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM c),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, st GROUP BY term, n),
idf AS MATERIALIZED (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25 FROM raw) ELSE raw END AS idf FROM raw),
a AS (SELECT trace_id, term, count(*) AS times FROM (SELECT trace_id, unnest({_TOK.format('question')}) AS term FROM {ASKED}) GROUP BY ALL),
lex AS MATERIALIZED (SELECT trace_id, chunk_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM a JOIN idf USING (term) JOIN p USING (term), st GROUP BY ALL)"""


def _index(spark: SparkSession, d: str) -> retrieval.LexicalIndex:
    return retrieval.lexical_index(chunks(spark, d, "text"), "chunk_id", "text")


def _lexical(spark: SparkSession, d: str, k: int, among: DataFrame | None = None) -> DataFrame:
    """The best ``k`` chunks of each question by their words."""
    scores = retrieval.bm25(questions(spark, d), _index(spark, d), "trace_id", "question", among=among)
    return relations.ranked(scores, ["trace_id"], F.col("score"), ["chunk_id"], k)


def _dense(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The best ``k`` chunks of each question by hashed vectors, which are never negative: 0 is no hit."""
    q = retrieval.hashed_vectors(questions(spark, d).withColumnRenamed("trace_id", "key"), "key", "question")
    c = retrieval.hashed_vectors(chunks(spark, d, "text").withColumnRenamed("chunk_id", "key"), "key", "text")
    found = retrieval.vector_topk(q, c, "key", "vector", k).where("score > 0")
    return found.select(F.col("query").alias("trace_id"), F.col("doc").alias("chunk_id"), "score", "rank")


@Q("bm25_topk", f"WITH {_BM25} SELECT trace_id, chunk_id, score, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, chunk_id) AS rank FROM lex QUALIFY rank <= 3")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, 3).withColumn("rank", F.col("rank").cast("long"))


_VEC = """{1} AS MATERIALIZED (SELECT k, b, c / sqrt(sum(c * c) OVER (PARTITION BY k)) AS w FROM (SELECT k, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS b, CAST(count(*) AS DOUBLE) AS c FROM (SELECT {2} AS k, unnest({3}) AS term FROM {0}) GROUP BY ALL))"""
_DENSE = (
    _VEC.format(CHUNKS, "cv", "chunk_id", _TOK.format("text")) + ", " + _VEC.format(ASKED, "qv", "trace_id", _TOK.format("question"))
    + ", den AS MATERIALIZED (SELECT qv.k AS trace_id, cv.k AS chunk_id, round(sum(qv.w * cv.w), 6) AS score FROM qv JOIN cv USING (b) GROUP BY ALL)"
)


@Q("hashed_dense_topk", f"WITH {_DENSE} SELECT trace_id, chunk_id, score, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, chunk_id) AS rank FROM den QUALIFY rank <= 3")
def hashed_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, 3).withColumn("rank", F.col("rank").cast("long"))


_LISTS = "l1 AS (SELECT trace_id, chunk_id, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, chunk_id) AS r, score FROM {0} QUALIFY r <= 25)"
_RRF = f"""WITH {_BM25}, {_DENSE}, {_LISTS.format('den')}, {_LISTS.format('lex').replace('l1', 'l2')},
f AS (SELECT trace_id, chunk_id, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT trace_id, chunk_id, r FROM l1 UNION ALL SELECT trace_id, chunk_id, r FROM l2) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, chunk_id) AS rank FROM f QUALIFY rank <= 3)"""


def _hybrid(spark: SparkSession, d: str, lexical: DataFrame) -> DataFrame:
    return retrieval.fuse([_dense(spark, d, 25), lexical], "trace_id", "chunk_id", 3)


@Q("rrf_fuse", _RRF + " SELECT * FROM top")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, _lexical(spark, d, 25)).withColumn("rank", F.col("rank").cast("long"))


@Q("rerank_two_stage", f"""WITH {_BM25}, {_DENSE}, {_LISTS.format('den')}
SELECT l1.trace_id, l1.chunk_id, coalesce(lex.score, 0) AS score, row_number() OVER (PARTITION BY l1.trace_id ORDER BY coalesce(lex.score, 0) DESC, l1.chunk_id) AS rank
FROM l1 LEFT JOIN lex USING (trace_id, chunk_id) QUALIFY rank <= 3""")  # fmt: skip
def rerank_two_stage(spark: SparkSession, d: str) -> DataFrame:
    """Dense candidates, ordered anew by their lexical score."""
    first = cut(_dense(spark, d, 25).drop("score"))
    scores = retrieval.bm25(questions(spark, d), _index(spark, d), "trace_id", "question", pairs=first)
    both = first.join(scores.withColumnRenamed("score", "lexical"), ["trace_id", "chunk_id"], "left")
    return retrieval.rerank(both, F.coalesce("lexical", F.lit(0.0)), "trace_id", "chunk_id", 25, 3).select("trace_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@Q("filtered_search", f"""WITH {_BM25} SELECT trace_id, chunk_id, score, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, chunk_id) AS rank
FROM lex JOIN (SELECT chunk_id FROM chunks WHERE policy_line = 'homeowners' AND in_force_from <= 20240630 AND in_force_to >= 20240630 GROUP BY chunk_id) USING (chunk_id) QUALIFY rank <= 3""")  # fmt: skip
def filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of one policy line in force on a day: filtered before they are scored."""
    fit = table(spark, d, "chunks").where("policy_line = 'homeowners' AND in_force_from <= 20240630 AND in_force_to >= 20240630").select("chunk_id").distinct()
    return _lexical(spark, d, 3, among=fit).withColumn("rank", F.col("rank").cast("long"))


@Q("retrieval_agreement", _RRF + " SELECT count(*) AS n, count(*) FILTER (rank <= 3) AS hits, round(count(*) FILTER (rank <= 3) / count(*), 6) AS hit_rate, round(count(*) FILTER (rank = 1) / count(*), 6) AS hit_at_1, round(avg(coalesce(CASE WHEN rank <= 3 THEN 1.0 / rank END, 0)), 6) AS mrr FROM (SELECT * FROM l2 WHERE r = 1) g LEFT JOIN top USING (trace_id, chunk_id)")
def retrieval_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often the best lexical hit is among the fused three, and where."""
    lexical = cut(_lexical(spark, d, 25))
    gold = lexical.where("rank = 1").select("trace_id", "chunk_id")
    return rates.hit_rates(gold.join(_hybrid(spark, d, lexical).select("trace_id", "chunk_id", "rank"), ["trace_id", "chunk_id"], "left"), [], "rank", 3)


_VTOP = """WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings{0})
SELECT q.vec_id AS query, c.vec_id AS doc, round(list_cosine_similarity(q.v, c.v), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, c.v), 6) DESC, c.vec_id) AS rank FROM q, c QUALIFY rank <= 10"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")


@Q("vector_topk", _VTOP.format(""))
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return retrieval.vector_topk(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 10).withColumn("rank", F.col("rank").cast("long"))


@Q("vector_topk_filtered", _VTOP.format(" WHERE label = 3"))
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return retrieval.vector_topk(v.where("vec_id % 20 = 0"), v.where("label = 3"), "vec_id", "embedding", 10).withColumn("rank", F.col("rank").cast("long"))


@Q("hit_rate_at_k", f"""SELECT retriever, count(*) AS n, count(*) FILTER (rank <= 3) AS hits, round(count(*) FILTER (rank <= 3) / count(*), 6) AS hit_rate, round(count(*) FILTER (rank = 1) / count(*), 6) AS hit_at_1, round(avg(coalesce(CASE WHEN rank <= 3 THEN 1.0 / rank END, 0)), 6) AS mrr
FROM (SELECT retriever, nullif(list_position(list_transform(retrieved, lambda x: x.chunk_id), citations[1]), 0) AS rank FROM {DEMO('retriever, retrieved, citations')}) GROUP BY retriever""")  # fmt: skip
def hit_rate_at_k(spark: SparkSession, d: str) -> DataFrame:
    """The first citation as the wanted chunk; answers without one are misses."""
    ids = F.transform("retrieved", lambda x: x["chunk_id"])
    rank = F.nullif(F.array_position(ids, F.get("citations", F.lit(0))), F.lit(0))
    return rates.hit_rates(demos(spark, d, "retriever", "retrieved", "citations").withColumn("rank", rank), ["retriever"], "rank", 3)


@Q("score_floor", f"SELECT retriever, count(*) AS n, count(*) FILTER (best_dense_score < 0.35) AS below, count(*) FILTER (refused_by = 'score floor') AS refused FROM {DEMO('retriever, best_dense_score, refused_by')} GROUP BY retriever")
def score_floor(spark: SparkSession, d: str) -> DataFrame:
    return demos(spark, d, "retriever", "best_dense_score", "refused_by").groupBy("retriever").agg(
        F.count("*").alias("n"), F.count_if(F.col("best_dense_score") < 0.35).alias("below"), F.count_if(F.col("refused_by") == "score floor").alias("refused"))


#: Words that say nothing of a question's matter: an own list of common English function words.
STOP = "about after again also another anything because been before being between could does doing down each either else every from have here into itself just like many might more must other over same should some such than that their them then there these they this those through until upon very was were what when where which while whom whose will with within without would your".split()


@Q("grounding_gate", f"""
WITH q AS (SELECT trace_id, best_dense_score AS s, retrieved[1].chunk_id AS c, list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9][a-z0-9\\-]{{3,}}'), lambda w: NOT list_contains({STOP}, w))) AS t FROM {DEMO('question, best_dense_score, retrieved')})
SELECT trace_id, CAST(len(list_filter(t, lambda w: contains(lower(text), w))) AS INTEGER) AS overlap, len(list_filter(t, lambda w: contains(lower(text), w))) >= 2 AND s >= 0.45 AS grounded
FROM q JOIN {CHUNKS} k ON k.chunk_id = q.c WHERE t IS NOT NULL""")  # fmt: skip
def grounding_gate(spark: SparkSession, d: str) -> DataFrame:
    """Question terms found in the best chunk, and whether term and score gates let it pass."""
    rows = demos(spark, d, "question", "best_dense_score", "retrieved").where("question IS NOT NULL").withColumn("terms", retrieval.question_terms(F.col("question"), STOP))
    rows = rows.withColumn("chunk_id", F.get("retrieved", F.lit(0))["chunk_id"]).join(chunks(spark, d, "text"), "chunk_id")
    overlap = F.size(F.filter("terms", lambda w: F.lower("text").contains(w)))
    return rows.select("trace_id", overlap.alias("overlap"), ((overlap >= 2) & (F.col("best_dense_score") >= 0.45)).alias("grounded"))


# ---- citations and context ----------------------------------------------------------------

_CITED = "list_sort(list_distinct(regexp_extract_all({0}, '[\\[【]([A-Z]{{2}}-\\d{{4}}_[\\d-]+#\\d{{2}})[\\]】]', 1)))"


@Q("citation_extract", f"SELECT trace_id, coalesce(array_to_string({_CITED.format('raw_output')}, ' '), '') AS cited FROM {DEMO('raw_output')}")
def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    return demos(spark, d, "raw_output").select("trace_id", F.array_join(tx.citations(F.col("raw_output")), " ").alias("cited"))


@Q("dangling_citations", f"SELECT trace_id, x AS ref FROM (SELECT trace_id, unnest(coalesce({_CITED.format('raw_output')}, [])) AS x, list_transform(retrieved, lambda r: r.chunk_id) AS ids FROM {DEMO('raw_output, retrieved')}) WHERE NOT coalesce(list_contains(ids, x), false)")
def dangling_citations(spark: SparkSession, d: str) -> DataFrame:
    ids = F.transform("retrieved", lambda r: r["chunk_id"])
    return demos(spark, d, "raw_output", "retrieved").select("trace_id", F.explode(tx.dangling(tx.citations(F.col("raw_output")), ids)).alias("ref"))


@Q("context_rebuild", f"""
SELECT trace_id, md5(coalesce(string_agg(text, chr(10) || '---' || chr(10) ORDER BY i), '')) AS context, count(*) FILTER (ref IS NOT NULL AND text IS NULL) AS missing
FROM (SELECT trace_id, i, retrieved[i].chunk_id AS ref FROM (SELECT trace_id, retrieved, unnest(range(1, greatest(coalesce(len(retrieved), 0), 1) + 1)) AS i FROM {DEMO('retrieved')})) r LEFT JOIN {CHUNKS} c ON c.chunk_id = r.ref GROUP BY trace_id""")  # fmt: skip
def context_rebuild(spark: SparkSession, d: str) -> DataFrame:
    found = relations.reading_order(demos(spark, d, "retrieved"), "retrieved", "chunk_id", chunks(spark, d, "text"), "chunk_id", "text", ["trace_id"], "\n---\n")
    return found.select("trace_id", F.md5("context").alias("context"), "missing")


@Q("named_and_held", f"SELECT trace_id, array_to_string(list_sort(list_intersect(list_distinct(regexp_extract_all(question, '[A-Z]{{2}}-\\d{{4}}')), list_distinct(list_transform(retrieved, lambda r: r.form_number)))), ' ') AS forms FROM {DEMO('question, retrieved')} WHERE question IS NOT NULL")
def named_and_held(spark: SparkSession, d: str) -> DataFrame:
    named = F.array_distinct(F.regexp_extract_all("question", F.lit(r"[A-Z]{2}-\d{4}"), F.lit(0)))
    held = F.transform("retrieved", lambda r: r["form_number"])
    return demos(spark, d, "question", "retrieved").where("question IS NOT NULL").select("trace_id", F.array_join(F.array_sort(F.array_intersect(named, held)), " ").alias("forms"))


@Q("corpus_codes", f"SELECT code, count(DISTINCT chunk_id) AS chunks FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '\\bE-\\d{{2}}\\b')) AS code FROM {CHUNKS}) GROUP BY code")
def corpus_codes(spark: SparkSession, d: str) -> DataFrame:
    codes = chunks(spark, d, "text").select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\bE-\d{2}\b"), F.lit(0)))).alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("chunks"))


@Q("unknown_codes", f"SELECT id, code FROM (SELECT id, unnest(list_distinct(regexp_extract_all(translate(grounds, '‐‑‒–—−', '------'), '\\bE-\\d{{2}}\\b'))) AS code FROM {ATT('grounds')}) WHERE code NOT IN (SELECT unnest(regexp_extract_all(text, '\\bE-\\d{{2}}\\b')) FROM chunks)")
def unknown_codes(spark: SparkSession, d: str) -> DataFrame:
    cited = F.array_distinct(F.regexp_extract_all(tx.same_hyphens(F.col("grounds")), F.lit(r"\bE-\d{2}\b"), F.lit(0)))
    known = table(spark, d, "chunks").select(F.explode(F.regexp_extract_all("text", F.lit(r"\bE-\d{2}\b"), F.lit(0))).alias("code"))
    return relations.violations(attempts(spark, d, "grounds").select("id", F.explode(cited).alias("code")), known, ["code"])


@Q("vocabulary", f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM {CHUNKS}) GROUP BY word")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "text").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


# ---- chunking -----------------------------------------------------------------------------


@Q("document_headers", "SELECT doc_id, trim(regexp_extract(text, '(?m)^FORM NUMBER:[ \\t]*([^\\r\\n]*)', 1)) AS form, trim(regexp_extract(text, '(?m)^POLICY LINE:[ \\t]*([^\\r\\n]*)', 1)) AS line FROM documents WHERE text IS NOT NULL")
def document_headers(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where(t.isNotNull()).select("doc_id", chunking.header_field(t, "FORM NUMBER").alias("form"), chunking.header_field(t, "POLICY LINE").alias("line"))


@Q("chunk_pack", f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM.format('x')}), lambda x: x != '') AS ps FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_reduce(ps, lambda acc, x: CASE WHEN length(replace(string_split(acc, chr(31))[-1], chr(10), '')) + length(x) <= 400 THEN acc || chr(10) || x ELSE acc || chr(31) || x END) AS packed FROM p WHERE len(ps) > 0),
u AS (SELECT doc_id, unnest(string_split(packed, chr(31))) AS chunk, unnest(range(len(string_split(packed, chr(31))))) AS pos FROM f)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(chunk) AS chunk FROM u""")  # fmt: skip
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    packed = chunking.pack_paragraphs(F.regexp_replace("text", "\x1f", ""), 400)
    return chunking.numbered(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", packed).select("doc_id", "pos", F.md5("chunk").alias("chunk"))


@Q("chunk_fixed", f"""
WITH w AS (SELECT doc_id, list_filter(list_transform(range(0, greatest(length(text), 1), 350), lambda i: {_TRIM.format('substr(text, CAST(i AS INTEGER) + 1, 400)')}), lambda x: x != '') AS ws FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(ws) AS chunk, unnest(range(len(ws))) AS pos FROM w)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(chunk) AS chunk FROM u""")  # fmt: skip
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return chunking.numbered(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", chunking.fixed_windows(F.col("text"))).select("doc_id", "pos", F.md5("chunk").alias("chunk"))


@Q("clause_sections", f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^(CLAUSE\\s+\\d)', chr(31) || '\\1', 'g'), chr(31)), lambda x: {_TRIM.format('x')}), lambda x: x != '') AS parts FROM (SELECT doc_id, replace(text, chr(31), '') AS text FROM documents WHERE text IS NOT NULL))
SELECT doc_id, CAST(len(parts) AS INTEGER) AS sections, md5(array_to_string(parts, chr(31))) AS content FROM s""")  # fmt: skip
def clause_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of every document: one where no clause starts, none in a blank one."""
    parts = chunking.clause_sections(F.regexp_replace("text", "\x1f", ""))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(parts).alias("sections"), F.md5(F.array_join(parts, "\x1f")).alias("content"))


@Q("table_rows", f"SELECT form_number, count(*) AS n FROM (SELECT form_number, unnest(string_split(text, chr(10))) AS line FROM {CHUNKS}) WHERE regexp_matches(line, '^[ \\t]*\\|[ \\t]*E-\\d') GROUP BY form_number")
def table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the structural splitter that are rows of an exclusion table, by form."""
    forms = chunks(spark, d, "text", "form_number")
    rows = chunking.structure_chunks(forms, "chunk_id", "text").where("row > 0")
    return rows.join(forms.select("chunk_id", "form_number"), "chunk_id").groupBy("form_number").agg(F.count("*").alias("n"))


@Q("word_counts", f"SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(table(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("n"))


# ---- text ---------------------------------------------------------------------------------

RULES = (("CLAIM_ID", r"\bCLM-\d{4}-\d{8}\b"), ("EMAIL", tx.EMAIL), ("PHONE", tx.PHONE))


def _rule_sql(c: str) -> str:
    for label, pattern in RULES:
        c = f"regexp_replace({c}, '{pattern}', '[{label}]', 'g')"
    return c


@Q("redact_rules", f"SELECT trace_id, {_rule_sql('question')} AS question FROM {DEMO('question')} WHERE question IS NOT NULL")
def redact_rules(spark: SparkSession, d: str) -> DataFrame:
    return demos(spark, d, "question").where("question IS NOT NULL").select("trace_id", tx.redact(F.col("question"), RULES).alias("question"))


@Q("redaction_counts", "SELECT label, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{label}' AS label, len(regexp_extract_all({c}, '{pattern}')) AS n FROM {DEMO('question')}"
    for (label, pattern), c in zip(RULES, ("question", f"regexp_replace(question, '{RULES[0][1]}', '[CLAIM_ID]', 'g')", f"regexp_replace(regexp_replace(question, '{RULES[0][1]}', '[CLAIM_ID]', 'g'), '{RULES[1][1]}', '[EMAIL]', 'g')"))
) + ") WHERE n > 0 GROUP BY label")
def redaction_counts(spark: SparkSession, d: str) -> DataFrame:
    return demos(spark, d, "question").select(F.explode(tx.redaction_counts(F.col("question"), RULES)).alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n"))


@Q("leak_check", f"SELECT source, count(*) FILTER (NOT ({' OR '.join(f'regexp_matches(question, {chr(39)}{p}{chr(39)})' for _, p in RULES)})) AS clean, count(*) AS n FROM {DEMO('source, question')} WHERE question IS NOT NULL GROUP BY source")
def leak_check(spark: SparkSession, d: str) -> DataFrame:
    rows = demos(spark, d, "source", "question").where("question IS NOT NULL")
    return rows.groupBy("source").agg(F.count_if(tx.is_clean(F.col("question"), RULES)).alias("clean"), F.count("*").alias("n"))


@Q("labelled_lines", f"SELECT id, nullif(trim(regexp_extract(summary, '(?im)^[ \\t]*COVERAGE POSITION[^:\\r\\n]*:([^\\r\\n]*)', 1)), '') AS pos, nullif(trim(regexp_extract(summary, '(?im)^[ \\t]*EXCESS[^:\\r\\n]*:([^\\r\\n]*)', 1)), '') AS excess FROM {ATT('summary')}")
def labelled_lines(spark: SparkSession, d: str) -> DataFrame:
    found = tx.labelled_lines(F.col("summary"), ["COVERAGE POSITION", "EXCESS", "GROUNDS"])
    return attempts(spark, d, "summary").withColumn("m", found).select("id", F.element_at("m", "COVERAGE POSITION").alias("pos"), F.element_at("m", "EXCESS").alias("excess"))


@Q("numbers_in", "SELECT claim_id, max(n) AS largest, count(*) AS numbers FROM (SELECT claim_id, try_cast(replace(unnest(regexp_extract_all(note, '\\d[\\d,]*')), ',', '') AS BIGINT) AS n FROM (SELECT claim_id, unnest(adjuster_notes) AS note FROM claims)) GROUP BY claim_id")
def numbers_in(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "claims").select("claim_id", F.explode("adjuster_notes").alias("note"))
    return notes.select("claim_id", F.explode(tx.numbers_in(F.col("note"))).alias("n")).groupBy("claim_id").agg(F.max("n").alias("largest"), F.count("*").alias("numbers"))


@Q("date_check", "SELECT coalesce(CASE WHEN regexp_full_match(date_of_loss, '\\d{4}-\\d\\d-\\d\\d') THEN CASE WHEN try_cast(date_of_loss AS DATE) IS NULL THEN 'impossible' ELSE 'ok' END WHEN date_of_loss IS NOT NULL THEN 'other form' END, 'missing') AS kind, count(*) AS n FROM claims GROUP BY 1")
def date_check(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("date_of_loss")
    kind = F.when(day.rlike(r"^\d{4}-\d\d-\d\d$"), F.when(day.try_cast("date").isNull(), "impossible").otherwise("ok")).when(day.isNotNull(), "other form").otherwise("missing")
    return table(spark, d, "claims").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@Q("fingerprints", f"SELECT source_file, substr(sha256(string_agg(replace(text, chr(13) || chr(10), chr(10)), chr(10) ORDER BY chunk_id)), 1, 12) AS sha FROM {CHUNKS} GROUP BY source_file")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """A fingerprint per source file over its chunks in order."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_id", F.replace("text", F.lit("\r\n"), F.lit("\n")).alias("text"))))
    return chunks(spark, d, "text", "source_file").groupBy("source_file").agg(tx.fingerprint(F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).alias("sha"))


@Q("previews", "SELECT doc_id, substr(trim(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' '), 1, 110) AS preview FROM documents WHERE text IS NOT NULL")
def previews(spark: SparkSession, d: str) -> DataFrame:
    text = F.trim(F.regexp_replace("text", r"[ \t\r\n\f]+", " "))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.substring(text, 1, 110).alias("preview"))


@Q("verdict_parse", "SELECT doc_id, nullif(upper(regexp_extract(text, '(?i)VERDICT:[ \\t\\r\\n]*(PASS|FAIL)', 1)), '') AS verdict FROM documents")
def verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.verdict(F.col("text")).alias("verdict"))


# ---- editions -----------------------------------------------------------------------------

_EDITIONS = "(SELECT form_number, edition, min(in_force_from) AS f, max(in_force_to) AS t FROM chunks GROUP BY ALL)"


@Q("validity_windows", f"WITH e AS (SELECT form_number, edition, strptime(CAST(f AS VARCHAR), '%Y%m%d')::DATE AS starts FROM {_EDITIONS}), s AS (SELECT form_number, starts, lead(starts) OVER (PARTITION BY form_number ORDER BY starts) AS nxt FROM (SELECT DISTINCT form_number, starts FROM e)) SELECT form_number, edition, starts, CAST(nxt - INTERVAL 1 DAY AS DATE) AS valid_to FROM e JOIN s USING (form_number, starts)")
def validity_windows(spark: SparkSession, d: str) -> DataFrame:
    editions = table(spark, d, "chunks").groupBy("form_number", "edition").agg(F.to_date(F.min("in_force_from").cast("string"), "yyyyMMdd").alias("starts"))
    return chunking.validity_windows(editions, "form_number", "starts").select("form_number", "edition", "starts", "valid_to")


@Q("edition_gate", f"""
WITH c AS (SELECT DISTINCT claim_id, upper(trim(translate(f, '‐‑‒–—−', '------'))) AS f FROM (SELECT claim_id, unnest(forms_attached) AS f FROM claims)),
p AS (SELECT claim_id, regexp_extract(f, '^([A-Z]{{2}}-\\d{{4}})\\s+ED\\.?\\s*([\\d-]+)$', 1) AS form, regexp_extract(f, '^([A-Z]{{2}}-\\d{{4}})\\s+ED\\.?\\s*([\\d-]+)$', 2) AS edition FROM c)
SELECT DISTINCT claim_id, form, edition FROM p WHERE form != '' AND (form, edition) NOT IN (SELECT (form_number, edition) FROM chunks)""")  # fmt: skip
def edition_gate(spark: SparkSession, d: str) -> DataFrame:
    """Attached (form, edition) pairs that the library does not hold."""
    pattern = r"^([A-Z]{2}-\d{4})\s+ED\.?\s*([\d-]+)$"
    attached = table(spark, d, "claims").select("claim_id", F.explode(F.transform("forms_attached", clean_key)).alias("f")).where(F.col("f").rlike(pattern))
    named = attached.select("claim_id", F.regexp_extract("f", pattern, 1).alias("form_number"), F.regexp_extract("f", pattern, 2).alias("edition")).distinct()
    return relations.violations(named, table(spark, d, "chunks"), ["form_number", "edition"]).select("claim_id", F.col("form_number").alias("form"), "edition")
