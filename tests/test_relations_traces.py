import pytest
from pyspark.sql import functions as F

from tidemark.operators import relations as rel
from tidemark.operators import traces


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_latest_and_upsert(spark):
    old = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 1, "c")], "k string, t int, v string")
    new = spark.createDataFrame([("k", 3, "d"), ("n", 1, "e")], "k string, t int, v string")
    assert rows(rel.latest_per_key(old, ["k"], [F.col("t")])) == [("k", 2, "b"), ("m", 1, "c")]
    assert rows(rel.upsert(old, new, ["k"], [F.col("t")])) == [("k", 3, "d"), ("m", 1, "c"), ("n", 1, "e")]


def test_pending_complete_and_by_id(spark):
    items = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    done = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert rows(rel.pending(items, done, "k")) == [(2,), (None,)]
    assert rows(rel.complete_join(done.where("k = 1"), spark.createDataFrame([(1, "x")], "k int, v string"), "k")) == [(1, "x"), (1, "x")]
    with pytest.raises(Exception, match="no partner for 2"):
        rel.complete_join(items.where("k IS NOT NULL"), spark.createDataFrame([(1, "x")], "k int, v string"), "k").collect()
    assert rows(rel.by_id(items, "k", 2)) == [(2,)]
    with pytest.raises(Exception, match="no k 9"):
        rel.by_id(items, "k", 9).collect()


def test_first_available(spark):
    s = "k int, v string"
    base, after, gate = (spark.createDataFrame(x, s) for x in ([(1, "b"), (2, None), (3, "b")], [(1, "a"), (2, "a")], [(2, "g"), (9, "g")]))
    assert rows(rel.first_available("k", "v", base, after, gate)) == [(1, "a", 1), (2, "g", 2), (3, "b", 0)]


def test_covering_interval_keeps_points_without_one(spark):
    points = spark.createDataFrame([("p", 5), ("p", 50), ("q", 5), (None, 5)], "k string, d int")
    spans = spark.createDataFrame([("p", 1, 9), ("p", 3, 7), ("q", 9, 10)], "k string, a int, b int")
    assert rows(rel.covering_interval(points, spans, "k", "d", "a", "b", ["a"], ["a", "b"])) == sorted([("p", 5, 1, 9), ("p", 50, None, None), ("q", 5, None, None), (None, 5, None, None)], key=str)


def test_lookup_status_and_order(spark):
    asked = spark.createDataFrame([("CLM-1",), ("CLM-9",), ("x",), (None,)], "c string")
    got = {r["c"]: r["status"] for r in rel.lookup_status(asked, spark.createDataFrame([("CLM-1",)], "c string"), "c", r"^CLM-\d$").collect()}
    assert got == {"CLM-1": "ok", "CLM-9": "not found", "x": "malformed", None: "malformed"}
    docs = spark.createDataFrame([("t", ["b", "a", "z"]), ("e", []), ("n", None)], "t string, ids array<string>")
    corpus = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, x string")
    got = {r["t"]: (r["context"], r["missing"]) for r in rel.reading_order(docs, "ids", "", corpus, "id", "x", ["t"], "|").collect()}
    assert got == {"t": ("B|A", 1), "e": ("", 0), "n": ("", 0)}


def test_samples_are_stable(spark):
    df = spark.range(500).withColumn("s", F.col("id") % 3)
    a, b = rows(rel.hash_sample(df, "id", 20, 1)), rows(rel.hash_sample(df.repartition(7), "id", 20, 1))
    assert a == b and len(a) == 20 and a != rows(rel.hash_sample(df, "id", 20, 2))
    assert rel.stratified_sample(df, "s", "id", 5, 1).groupBy("s").count().where("count = 5").count() == 3


def test_containing_texts_and_last_best(spark):
    texts = spark.createDataFrame([(1, "HM-1 and HM-2"), (2, None)], "k int, t string")
    marks = spark.createDataFrame([("HM-2",), ("HM-2",), ("HM-3",)], "m string")
    assert rows(rel.containing_texts(texts, "k", "t", marks, "m", r"HM-\d")) == [(1, "HM-2")]
    hits = spark.createDataFrame([("q", 1.0, 1, "a"), ("q", 1.0, 2, "b"), ("q", 0.5, 3, "c")], "q string, s double, i int, d string")
    assert rows(rel.last_best(hits, ["q"], "s", "i", "d")) == [("q", "b")]


LAPS = "id string, laps array<struct<prompt_tokens: int, completion_tokens: int, call_s: double, wait_s: double, tools: array<struct<tool: string>>>>"


def test_rollup_and_budgets(spark):
    df = spark.createDataFrame([("a", [(10, 1, 1.0, 0.5, [("x",), None, ("y",)]), None, (20, None, 2.0, None, [("x",), (None,)])]), ("b", []), ("c", None)], LAPS)
    got = {r["id"]: r for r in traces.trace_rollup(df, "laps").collect()}
    a = got["a"]
    assert (a["n_laps"], a["lap_prompt"], a["lap_completion"], a["active_s"], a["waited_s"], a["sent_again"], a["tool_order"]) == (3, 30, 1, 3.0, 0.5, 20, ["x", "y"])
    assert [got[k]["n_laps"] for k in "bc"] == [0, 0] and got["c"]["tool_order"] == []
    limits = lambda most: [traces.Limit("tokens", lambda x: x["prompt_tokens"], most), traces.Limit("laps", lambda x: F.lit(1), 2)]
    assert rows(traces.running_budget(df, "id", "laps", limits(10))) == [("a", 1, "tokens")]
    assert rows(traces.running_budget(df, "id", "laps", limits(99))) == [("a", 2, "laps")]
    assert rows(traces.budget_left(df, "id", "laps", F.col("x.prompt_tokens"), 12, 5)) == [("a", 0, 5.0), ("a", 1, 2.0), ("a", 2, 2.0)]


def test_sequences(spark):
    df = spark.createDataFrame([("a", ["get", "pay", "get"]), ("b", ["pay"]), ("c", []), ("d", None), ("e", [None, "pay"])], "id string, path array<string>")
    assert rows(traces.order_violations(df, "id", "path", {"pay": "get"})) == [("b", 0, "pay", "get"), ("e", 1, "pay", "get")]
    got = {r["id"]: r["ok"] for r in df.withColumn("ok", traces.sequence_accepted(F.col("path"), "get( pay)?( get)*")).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": False}


def test_unseen_values(spark):
    df = spark.createDataFrame([("a", [(["1"], ["2"]), (["2", "3"], ["3"]), (["3"], None)])], "id string, calls array<struct<u: array<string>, p: array<string>>>")
    assert rows(traces.unseen_values(df, "id", "calls", F.col("x.u"), F.col("x.p"))) == [("a", 0, "1"), ("a", 1, "3")]


def test_scaling_keeps_the_total(spark):
    df = spark.createDataFrame([(1, 2, 10), (0, 0, 5), (None, 3, 7)], "a int, b int, t bigint")
    x, y = traces.scale_to_total([F.col("a"), F.col("b")], F.col("t"))
    assert all(r["x"] + r["y"] == r["t"] for r in df.select("t", x.alias("x"), y.alias("y")).collect())
