from pyspark.sql import functions as F

from tidemark.functions import registry
from tidemark.functions.keys import form_guess
from tidemark.operators import chunking, relations, traces


def test_budgets_fire_in_their_order(spark):
    rows = [("a", [(3, 1.0), (4, None), None, (9, 9.0)]), ("b", []), ("c", None), ("d", [(0, 0.0)] * 2), (None, [(50, 0.0), (1, 0.0)])]
    df = spark.createDataFrame(rows, "k string, items array<struct<n: int, s: double>>")
    limits = [traces.Limit("laps", lambda x: F.lit(1), 4), traces.Limit("tokens", lambda x: x["n"], 20, 14), traces.Limit("wall", lambda x: x["s"], 1.0)]
    got = {r["k"]: (r["pos"], r["limit"]) for r in traces.running_budget(df, "k", "items", limits).collect()}
    assert got == {"a": (1, "wall"), None: (1, "tokens")}
    plan = traces.running_budget(df, "k", "items", limits)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert traces.running_budget(df.limit(0), "k", "items", limits).collect() == []


def brute_lines(text, size):
    paras, start, buf = [], None, []
    for i, line in enumerate([*text.split("\n"), ""], 1):
        if line.strip(" \t\r\n\f\v"):
            start = start if buf else i
            buf.append(line)
        elif buf:
            paras.append(("\n".join(buf).strip(" \t\r\n\f\v"), start))
            buf = []
    out = []
    for p, line in paras:
        if out and len(out[-1][0]) + len(p) <= size:
            out[-1] = (out[-1][0] + "\n\n" + p, out[-1][1])
        else:
            out.append((p, line))
    return out


def test_chunks_with_their_lines(spark):
    texts = ["", " \n ", "one", "a\n\nb\n \n\nc\nd", "\n\n  x\n\n\n" + "y" * 30 + "\n\nz", "a\r\n\r\nb", "w " * 40 + "\n\n" + "v\n" * 5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", chunking.pack_with_lines(F.col("t"), 20).alias("c")).collect()}
    assert got.pop(99) is None
    for i, text in enumerate(texts):
        assert [(x["chunk"], x["line"]) for x in got[i]] == brute_lines(text, 20), text


def test_resume_only_under_the_same_inputs(spark):
    items = spark.createDataFrame([("a", "v1"), ("b", "v1"), ("c", "v1")], "id string, sha string")
    done = lambda *rows: spark.createDataFrame(list(rows), "id string, sha string")
    left = lambda d: sorted(r["id"] for r in relations.resume(items, d, "id", ["sha"]).collect())
    assert left(done(("a", "v1"), ("a", "v1"), ("z", "v1"))) == ["b", "c"]
    assert left(done(("a", "v1"), ("b", "v0"))) == ["a", "b", "c"] == left(done())
    assert left(done(("a", None))) == ["a", "b", "c"]


def test_expectations(spark):
    rows = [("covered", "E‑77", ["DENIED"], None, ["E-77"]), ("denied", None, ["DENIED"], [], []), ("DENIED", "", None, ["COVERED"], None), ("x", "E-1", None, None, ["E-77"]), (None, None, None, [], None)]
    df = spark.createDataFrame(rows, "p string, g string, a array<string>, b array<string>, c array<string>")
    got = [tuple(r["e"]) for r in df.select(registry.expect_check(*map(F.col, "pgabc")).alias("e")).collect()]
    assert got == [(True, "as expected"), (False, "position forbidden"), (False, "position not allowed"), (False, "no code cited"), (True, "nothing expected")]


def test_replies(spark):
    rows = ["", None, "no braces", "{cut", "say {\"a\": 1} ok", '{"a": 1, "n": null, "b": [1]}', '{"a": 1, "n": "x", "b": 2}', '{"a": {"b": 1}', '{"b": 1, "a": 2, "n": 2.5}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r["i"]: tuple(r["v"]) for r in df.select("i", registry.validated(F.col("t"), ["a", "b"], ["n"]).alias("v")).collect()}
    assert [got[i][1] for i in range(9)] == ["empty reply", "empty reply", "no JSON object", "no JSON object", "missing keys: b", None, "n is no number", "invalid JSON", None]
    assert got[5][0] == rows[5] and got[6][0] is None


def test_form_guess(spark):
    df = spark.createDataFrame([("HM 08 20",), ("hm-0820 ed. 05-24",), ("HM-0820",), (None,)], "f string")
    assert [r["g"] for r in df.select(form_guess(F.col("f")).alias("g")).collect()] == ["HM-0820"] * 3 + [None]
