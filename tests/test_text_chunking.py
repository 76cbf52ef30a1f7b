import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import chunking, retrieval


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("c")).first()["c"]


@pytest.fixture(autouse=True)
def column(spark):
    global T
    T = F.col("t")


def test_packing_is_greedy_and_keeps_text(spark):
    text = "aa\n\nbbb\n cccc \n" + "d" * 20 + "\ne\n"
    got = one(spark, chunking.pack_paragraphs(T, 9), text)
    assert got == ["aa\nbbb\ncccc", "d" * 20, "e"]
    assert one(spark, chunking.pack_paragraphs(T, 9), " \n ") == [] and one(spark, chunking.pack_paragraphs(T, 9), None) is None
    long = "\n".join(f"line {i}" for i in range(5000))
    assert "\n".join(one(spark, chunking.pack_paragraphs(T, 400), long)) == long


def test_fixed_windows(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    assert one(spark, chunking.fixed_windows(T), text) == [text[i : i + 400] for i in range(0, 1000, 350)]
    assert one(spark, chunking.fixed_windows(T), "") == []


def test_clauses_and_table_rows(spark):
    text = "HEAD\nCLAUSE 1. A\nx\n| E-01 | p |\n| E-02 | q |\nCLAUSE 2. B\ny"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = [tuple(r) for r in chunking.structure_chunks(df, "id", "t").orderBy("section", "row").collect()]
    assert got == [(1, 0, 0, "HEAD"), (1, 1, 0, "CLAUSE 1. A\nx"), (1, 1, 1, "CLAUSE 1. A\n| E-01 | p |"), (1, 1, 2, "CLAUSE 1. A\n| E-02 | q |"), (1, 2, 0, "CLAUSE 2. B\ny")]


def test_headers(spark):
    text = "FORM NUMBER: HM-1\nPOLICY LINE:\nFORM NUMBER: HM-2"
    assert one(spark, chunking.header_field(T, "FORM NUMBER"), text) == "HM-1"
    assert one(spark, chunking.header_field(T, "POLICY LINE"), text) == "" == one(spark, chunking.header_field(T, "TITLE"), text)


def test_validity_windows(spark):
    rows = [("f", "2023-03-24", "a"), ("f", "2025-01-01", "b"), ("g", "2024-01-01", "c")]
    df = spark.createDataFrame(rows, "form string, d string, ed string").withColumn("d", F.to_date("d"))
    got = {r["ed"]: r["valid_to"] and str(r["valid_to"]) for r in chunking.validity_windows(df, "form", "d").collect()}
    assert got == {"a": "2024-12-31", "b": None, "c": None}


def test_citations_and_lines(spark):
    assert one(spark, tx.citations(T), "see [HM-0001_01-24#02], 【DF-0002_03-25#00】 and [HM-0001_01-24#02] [x]") == ["DF-0002_03-25#00", "HM-0001_01-24#02"]
    assert one(spark, tx.citations(T), None) == []
    got = one(spark, tx.labelled_lines(T, ["POSITION", "EXCESS", "OTHER"]), "Position: covered\nEXCESS: 500\nposition: denied\nother:  ")
    assert got == {"POSITION": "covered", "EXCESS": "500"}


def test_redaction(spark):
    rules = [("CLAIM", tx.CLAIM), ("EMAIL", tx.EMAIL), ("PHONE", tx.PHONE)]
    text = "clm-2024-00000001 a.b@x.org (555) 123-4567 E-17 stays"
    clean = one(spark, tx.redact(T, rules), text)
    assert clean == "[CLAIM] [EMAIL] [PHONE] E-17 stays"
    assert one(spark, tx.redact(T, rules), clean) == clean
    assert one(spark, tx.redaction_counts(T, rules), text + " " + text) == {"CLAIM": 2, "EMAIL": 2, "PHONE": 2}
    assert one(spark, tx.is_clean(T, rules), clean) and not one(spark, tx.is_clean(T, rules), text)
    assert not one(spark, tx.is_clean(T, rules, F.array(F.lit("STAYS"))), clean)


def test_numbers_verdicts_waits(spark):
    assert one(spark, tx.numbers_in(T), "1,200 and 7, then 0015") == [1200, 7, 15]
    assert one(spark, tx.verdict(T), "<think>VERDICT: FAIL</think>\nverdict: pass because") == "PASS"
    assert one(spark, tx.verdict(T), "none") is None
    assert [one(spark, tx.wait_seconds(T), x) for x in ("try in 7m2.5s", "in 1h2m3s", "in 4.25s", "later")] == [422.5, 900.0, 4.25, None]
    q = one(spark, tx.quota_fields(T), "Rate limit on TPM: Limit 8000, Used 5999, Requested 2637. Try again in 20s")
    assert tuple(q) == ("TPM", 8000, 5999, 2637, 20.0)
    assert one(spark, tx.quota_fields(T), "boom")["unit"] == "unknown"


def test_json_and_fingerprints(spark):
    assert one(spark, tx.json_object(T), 'so {"a": {"b": 1}} done') == '{"a": {"b": 1}}' and one(spark, tx.json_object(T), "no") is None
    assert one(spark, tx.fingerprint(T), "a\r\nb") == hashlib.sha256(b"a\nb").hexdigest()[:12]
    assert tuple(one(spark, tx.split_first(T), "HM-1: para: 2")) == ("HM-1", "para: 2") and tuple(one(spark, tx.split_first(T), "HM-1")) == ("HM-1", None)
    assert one(spark, tx.render("x {a} {b} {c}", {"a": T, "b": F.lit(2)}), "{b}") == "x {b} 2 {c}"
    assert one(spark, tx.problems(a=T.isNull(), b=T == "x", c=F.lit(None).cast("boolean")), "x") == ["a", "c"]
    assert one(spark, tx.numeric_entries(F.create_map(F.lit("n"), T, F.lit("w"), F.lit("word"))), "12") == {"n": 12.0}
    assert one(spark, tx.contains_word(T, ["covered"]), "not Covered!") and not one(spark, tx.contains_word(T, ["covered"]), "uncovered")
    assert "-a" in one(spark, tx.text_diff(T, F.lit("a\nc")), "a\nb").splitlines()[-2:][0] or "+c" in one(spark, tx.text_diff(T, F.lit("a\nc")), "a\nb")
    assert one(spark, tx.route(T, ["u1"], "v1", "v2"), "u1") == "v2" and one(spark, tx.route(T, ["u1"], "v1", "v2"), None) == "v1"
    assert one(spark, tx.rounded_fraction(F.lit(1), F.lit(3)), "") == "1/3 33%"


def test_bm25_against_brute_force(spark):
    import math
    import re

    docs = {"a": "the cat sat on the mat", "b": "a dog and a cat", "c": "fish", "d": "the the the", "e": ""}
    asked = {"q": "the cat cat"}
    toks = {k: re.findall(r"[a-z0-9\-]+", v) for k, v in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    idf = {t: math.log(n - (df := sum(t in x for x in toks.values())) + 0.5) - math.log(df + 0.5) for t in {t for x in toks.values() for t in x}}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    want = {k: sum(idf[t] * (f := x.count(t)) * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t in re.findall(r"[a-z0-9\-]+", asked["q"]) if t in x) for k, x in toks.items()}
    got = retrieval.bm25(spark.createDataFrame(list(asked.items()), "q string, t string"), retrieval.lexical_index(spark.createDataFrame(list(docs.items()), "k string, d string"), "k", "d"), "q", "t")
    assert {r["k"]: r["score"] for r in got.collect()} == {k: round(v, 6) for k, v in want.items() if v}


def test_vector_topk_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300, None), (301, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = {}
    for r in retrieval.vector_topk(df.where("id % 20 = 0"), df, "id", "v", 5, cell=64).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["doc"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 20):
        want = sorted(range(300), key=lambda j: (-round(float(u[q] @ u[j]), 6), j))[:5]
        assert [got[q][i] for i in range(1, 6)] == want


def test_fusion_does_not_see_scores(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "q string, d string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "q string, d string, rank int")
    got = [(r["d"], r["rank"]) for r in retrieval.fuse([a, b], "q", "d", 3).orderBy("rank").collect()]
    assert got == [("y", 1), ("x", 2), ("z", 3)]


def test_search_among_some_documents_and_of_given_pairs(spark):
    docs = spark.createDataFrame([("a", "wind and hail"), ("b", "hail on roof"), ("c", "fire"), ("d", None)], "k string, d string")
    asked = spark.createDataFrame([("q1", "hail roof"), ("q2", "fire wind"), ("q3", None)], "q string, t string")
    index = retrieval.lexical_index(docs, "k", "d")
    whole = {(r["q"], r["k"]): r["score"] for r in retrieval.bm25(asked, index, "q", "t").collect()}
    assert set(whole) == {("q1", "a"), ("q1", "b"), ("q2", "a"), ("q2", "c")}
    some = retrieval.bm25(asked, index, "q", "t", among=docs.where("k IN ('a', 'c')"))
    assert {(r["q"], r["k"]): r["score"] for r in some.collect()} == {p: s for p, s in whole.items() if p[1] != "b"}
    pairs = spark.createDataFrame([("q1", "b", 1), ("q2", "b", 2), ("q9", "a", 3)], "q string, k string, rank int")
    assert {(r["q"], r["k"]): r["score"] for r in retrieval.bm25(asked, index, "q", "t", pairs=pairs).collect()} == {("q1", "b"): whole["q1", "b"]}
    vectors = {r["k"]: r["vector"] for r in retrieval.hashed_vectors(docs, "k", "d").collect()}
    assert set(vectors) == {"a", "b", "c"} and sum(vectors["a"]) == 3 and len(vectors["c"]) == retrieval.BUCKETS
