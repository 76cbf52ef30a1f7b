import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.registry import ToolRegistry, run_checks
from tidemark.sources import files
from tidemark.streaming import streams


def test_text_json_and_run_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("FORM NUMBER: B\n\nx")
    (tmp_path / "a.txt").write_text("one")
    got = [tuple(r) for r in files.text_files(spark, str(tmp_path)).orderBy("file").collect()]
    assert got == [("a.txt", "one"), ("b.txt", "FORM NUMBER: B\n\nx")]
    log = tmp_path / "run.jsonl"
    log.write_text('{"type": "header", "sha": "s"}\n\n{"id": "1", "verdict": "PASS"}\n{"id": "2"}\n')
    head, items = files.run_file(spark, str(log), "sha string", "id string, verdict string")
    assert [tuple(r) for r in head.collect()] == [("s",)] and sorted(map(tuple, items.collect()), key=str) == [("1", "PASS"), ("2", None)]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": 1}\nnot json\n')
    assert [r["_corrupt"] for r in files.json_lines(spark, str(bad), "id int").collect()] == [None, "not json"]
    doc = tmp_path / "map.json"
    doc.write_text(json.dumps({"P1": {"line": "home"}, "P2": {"line": None}}))
    assert sorted(map(tuple, files.json_map(spark, str(doc), "line: string", "policy").collect())) == [("P1", "home"), ("P2", None)]
    arr = tmp_path / "arr.json"
    arr.write_text('[{"a": 1}, {"a": 2}]')
    assert files.json_array(spark, str(arr), "a int").count() == 2


def test_day_log_appends_prunes_and_refuses(spark, tmp_path):
    out = str(tmp_path / "log")
    df = spark.createDataFrame([("1", "2024-01-01T23:00:00-07:00", "x"), ("2", "2024-01-02T00:00:00Z", "y")], "id string, ts string, note string")
    files.append_day_log(df, out)
    files.append_day_log(df.limit(1).withColumn("id", F.lit("3")), out)
    assert files.day_log(spark, out, "id string, ts string, note string").count() == 3
    one = files.day_log(spark, out, "id string, ts string", "2024-01-01")
    assert sorted(r["id"] for r in one.collect()) == ["1", "3"]
    with pytest.raises(Exception, match="leak"):
        files.append_day_log(df, out, checks=[("leak", F.col("note") != "y")])
    assert files.day_log(spark, out, "id string").count() == 3


def test_csv_access_log_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.123456789, ["a", "b"]), (2, None, None)], "i int, x double, l array<string>")
    files.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("i").collect()
    assert tuple(back[0]) == ("1", "0.123457", "a; b")
    log = tmp_path / "access.log"
    log.write_text("2024-01-01T00:00:00Z token=- tool=get claim=CLM-1\nnoise\n")
    assert [tuple(r) for r in files.access_log(spark, str(log)).collect()] == [("2024-01-01T00:00:00Z", "-", "get", "CLM-1")]
    assert files.markdown_table(df.select("i").orderBy("i")) == "| i |\n| --- |\n| 1 |\n| 2 |"
    with pytest.raises(ValueError, match="no report"):
        files.markdown_table(df, limit=1)


def test_tools_answer_with_value_or_error(spark):
    tools = ToolRegistry()

    @tools.tool("add", "a", "b")
    def add(a, b):
        return a + b

    @tools.tool("fail")
    def fail():
        raise RuntimeError("no")

    rows = [("add", '{"a": 1, "b": 2}'), ("add", '{"a": 1}'), ("add", "{"), ("add", json.dumps('{"a": 1, "b": 1}')), ("fail", None), ("nope", "{}"), (None, None)]
    df = spark.createDataFrame(rows, "t string, args string").coalesce(1)
    got = [tuple(r["r"]) for r in df.select(tools.column(F.col("t"), F.col("args")).alias("r")).collect()]
    assert got == [("3", None), (None, "bad arguments: a, b needed"), (None, "bad arguments: not JSON"), ("2", None), (None, "RuntimeError: no"), (None, "unknown tool nope"), (None, "unknown tool None")]
    tools.register(spark, "call_tool")
    assert spark.sql("""SELECT call_tool('add', '{"a": 1, "b": 2}').value AS v""").first()["v"] == "3"
    assert [tuple(r) for r in tools.listing(spark).collect()] == [("add", ["a", "b"]), ("fail", [])]
    with pytest.raises(ValueError, match="two tools"):
        tools.tool("add")(add)
    checked = run_checks(df.limit(1), {"named": (F.col("t").isNotNull(), F.lit("x")), "unknown": (F.lit(None).cast("boolean"), F.lit(None))})
    assert [(c["name"], c["passed"]) for c in checked.first()["checks"]] == [("named", True), ("unknown", False)]


T = lambda m: dt.datetime(2024, 1, 1, 0, m)
EVENTS = "id int, user string, ts timestamp, value double"


def test_stream_takes_each_row_once_over_runs(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = spark.createDataFrame([], EVENTS).schema
    spark.createDataFrame([(1, "a", T(1), 1.0)], EVENTS).write.parquet(src)
    run = lambda: streams.run_available(streams.parquet_stream(spark, src, schema), out, state)
    run()
    run()
    spark.createDataFrame([(2, "a", T(2), 1.0)], EVENTS).write.mode("append").parquet(src)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_windows_sessions_and_memo(spark, tmp_path):
    rows = [(1, "a", T(1), 1.0), (2, "a", T(4), 2.0), (3, "a", T(30), 1.0), (3, "a", T(30), 1.0), (9, "z", T(59), 0.0)]
    df = spark.createDataFrame(rows, EVENTS)
    assert {(r["start"].minute, r["n"]) for r in streams.tumbling(df.where("user = 'a'"), "ts", "10 minutes", ["user"]).collect()} == {(0, 2), (30, 2)}
    assert {r["n"] for r in streams.sliding(df.where("id = 1"), "ts", "10 minutes", "5 minutes", ["user"]).collect()} == {1}
    assert sorted(r["n"] for r in streams.sessions(df.where("user = 'a'"), "ts", "5 minutes", ["user"]).collect()) == [2, 2]
    memo = spark.createDataFrame([(1,), (9,)], "id int")
    assert sorted(r["id"] for r in streams.with_memo(df, memo, "id").collect()) == [2, 3, 3]


def test_budget_state_and_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i, "a" if i % 2 else "b", T(i), 1.0 if i % 2 else 0.1) for i in range(20)]
    df = spark.createDataFrame(rows, EVENTS)
    df.write.parquet(src)
    stream = streams.parquet_stream(spark, src, df.schema)
    streams.run_available(streams.budget_stops(stream, "user", "value", 5.0), str(tmp_path / "out"), str(tmp_path / "st"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 10, 10.0)]
    seen = []
    streams.run_batches(stream, lambda b, i: seen.append(b.count()), str(tmp_path / "st2"), "append")
    assert sum(seen) == 20
