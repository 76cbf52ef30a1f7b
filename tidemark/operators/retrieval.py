"""Lexical, dense and fused retrieval with metadata filters."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import hot_keys, salted_join
from tidemark.operators.relations import ranked
from tidemark.session import cut

#: A lexical token, and the public defaults of the Okapi ranking.
TOKEN = r"[a-z0-9\-]+"
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
BUCKETS = 64  # of the stand-in for an embedding


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters, digits and hyphens; null gives an empty list."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def question_terms(text: Column, stop: Sequence[str], least: int = 4) -> Column:
    """Distinct words of at least ``least`` letters that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"[a-z0-9][a-z0-9\-]{{{least - 1},}}"), F.lit(0))
    return F.array_except(F.coalesce(words, F.array().cast("array<string>")), F.array(*map(F.lit, stop)))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(term, key, tf, dl)``: term frequencies with the document's length."""
    words = docs.select(key, tokenize(F.col(text)).alias("w")).select(key, F.size("w").alias("dl"), F.explode("w").alias("term"))
    return words.groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


class LexicalIndex(NamedTuple):
    """Postings, kept, with the statistics of all documents: shared by every search over them."""

    key: str
    postings: DataFrame  # (term, key, tf, dl)
    weights: DataFrame  # (term, avgdl, idf)
    hot: list[str]


def lexical_index(docs: DataFrame, key: str, text: str) -> LexicalIndex:
    """The index of a corpus.

    Inverse document frequency ``ln(n - df + .5) - ln(df + .5)``; a negative one is replaced by
    a quarter of the mean.  Statistics cover all documents, also those a search leaves out.
    """
    index = cut(postings(docs, key, text))
    size = docs.select(F.size(tokenize(F.col(text))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    hot = hot_keys(df.withColumnRenamed("df", "n"), "term", index.count())
    idf = df.join(F.broadcast(size)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = idf.agg((F.avg("raw") * EPSILON).alias("floor"))
    weights = idf.join(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))  # one row
    return LexicalIndex(key, index, weights, hot)


def bm25(queries: DataFrame, index: LexicalIndex, query: str, question: str, among: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """``(query, key, score)`` for every pair that shares a term; a term asked twice counts twice.

    ``among(key)`` are the documents to look in: their postings are taken out of the index
    before any meets a question.  ``pairs(query, key)`` are the only pairs to score, which
    costs as much as there are pairs.  Terms that hold more than 1/64 of the postings are
    salted by document in the join with the questions.
    """
    key = index.key
    asked = queries.select(query, F.explode(tokenize(F.col(question))).alias("term")).groupBy(query, "term").agg(F.count("*").alias("times"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    held = index.postings if among is None else index.postings.join(among.select(key), key, "left_semi")
    weighed = asked.join(index.weights, "term")
    if pairs is None:
        found = salted_join(held, weighed, ["term"], index.hot, F.col(key))
    else:
        found = weighed.join(pairs.select(query, key), query).join(held, [key, "term"])
    return found.groupBy(query, key).agg(F.round(F.sum(part), 6).alias("score"))


def hashed_vectors(docs: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """``(key, vector)``: a deterministic stand-in for an embedding model; texts without words have none."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col("term")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    words = docs.select(key, F.explode(tokenize(F.col(text))).alias("term")).select(key, bucket.alias("bucket"))
    counts = words.groupBy(key, "bucket").agg(F.count("*").cast("double").alias("c"))
    met = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "c"))).alias("m"))
    return met.select(key, F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vector"))


def vector_topk(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, cell: int = 20_000, rows: int = 500) -> DataFrame:
    """``(query, key, score, rank)``: exact cosine top ``k`` of every query over the whole corpus.

    Scores are rounded to 6 places before ranking, ties go to the lesser key.  Zero vectors
    score 0; null vectors take no part.  Queries and corpus are cut into cells of about
    ``cell`` rows, which bounds how often a vector is sent; each pair of cells is a matrix
    product, ``rows`` queries at a time, that gives ``k`` rows a query, and the partial lists
    are ranked once more.
    """
    q, c = (d.where(F.col(vector).isNotNull()).select(F.col(key).alias(n), F.col(vector).alias("v")) for d, n in ((queries, "query"), (corpus, "doc")))
    nq, nc = max(1, -(-queries.count() // cell)), max(1, -(-corpus.count() // cell))
    kind = queries.schema[key].dataType.simpleString()
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("qc", F.pmod(F.xxhash64("query"), F.lit(nq)).cast("int")).withColumn("cc", cells(nc))
    right = c.withColumn("cc", F.pmod(F.xxhash64("doc"), F.lit(nc)).cast("int")).withColumn("qc", cells(nq))

    def unit(column: pd.Series) -> np.ndarray:
        m = np.array(column.tolist(), float)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "doc": [], "score": []})
        b = b.sort_values("doc", kind="stable")
        left, right, parts = unit(a["v"]), unit(b["v"]).T, []
        for lo in range(0, len(a), rows):
            s = np.round(left[lo : lo + rows] @ right, 6) + 0.0
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            parts.append((top, np.take_along_axis(s, top, 1)))
        top, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({"query": np.repeat(a["query"].to_numpy(), top.shape[1]), "doc": b["doc"].to_numpy()[top.ravel()], "score": s.ravel()})

    pairs = left.groupBy("qc", "cc").cogroup(right.groupBy("qc", "cc")).applyInPandas(best, f"query {kind}, doc {kind}, score double")
    return ranked(pairs, ["query"], F.col("score"), ["doc"], k)


def fuse(lists: Sequence[DataFrame], query: str, key: str, k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists ``(query, key, rank)``: top ``k`` by the sum of
    ``1 / (60 + rank)``, ties by key."""
    whole = lists[0].select(query, key, "rank")
    for more in lists[1:]:
        whole = whole.unionByName(more.select(query, key, "rank"))
    fused = whole.groupBy(query, key).agg(F.round(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))), 9).alias("score"))
    return ranked(fused, [query], F.col("score"), [key], k)


def rerank(candidates: DataFrame, scores: Column, query: str, key: str, depth: int, k: int) -> DataFrame:
    """The best ``depth`` of each query by their ``rank``, ordered anew by ``scores``, best ``k``."""
    kept = candidates.where(F.col("rank") <= depth).withColumn("score", scores).drop("rank")
    return ranked(kept, [query], F.col("score"), [key], k)
