import math
import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import rates
from tidemark.operators.ranks import LOWER_MIDDLE, UPPER_MIDDLE, iqr_outliers, nearest_rank, order_statistics, rounded_index


def test_order_statistics_of_hot_and_null_groups(spark):
    r = random.Random(2)
    rows = [(g, float(r.randint(0, 50))) for g in [None] * 7 + ["hot"] * 400 + ["one"]] + [("hot", None), ("hot", float("nan")), ("none", None)]
    got = order_statistics(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p50": nearest_rank(50), "p99": nearest_rank(99), "q1": rounded_index(0.25), "lo": LOWER_MIDDLE, "hi": UPPER_MIDDLE}).collect()
    assert {x["g"] for x in got} == {None, "hot", "one"}
    for x in got:
        v = sorted(b for a, b in rows if a == x["g"] and b is not None and not math.isnan(b))
        n = len(v)
        assert (x["n"], x["p50"], x["p99"], x["q1"]) == (n, v[max(1, math.ceil(0.5 * n)) - 1], v[max(1, math.ceil(0.99 * n)) - 1], v[int(0.25 * (n - 1) + 0.5)])
        assert (x["lo"] + x["hi"]) / 2 == statistics.median(v)


def test_outliers_and_fallback(spark):
    rows = [("a", float(i), f"r{i}") for i in range(20)] + [("a", 500.0, "far"), ("b", 1.0, "b1"), ("b", 2.0, "b2"), ("c", None, "c1")]
    got = {(x["g"], x["id"], x["side"]) for x in iqr_outliers(spark.createDataFrame(rows, "g string, v double, id string"), ["g"], "v", fallback=1).collect()}
    assert got == {("a", "far", "high"), ("b", "b1", "lowest"), ("b", "b2", "highest")}


def test_kappa_against_its_formula(spark):
    pairs = [("PASS", "PASS")] * 10 + [("PASS", "FAIL")] * 3 + [("FAIL", "PASS")] * 4 + [("FAIL", "FAIL")] * 8 + [("PASS", None), (None, "PASS")]
    row = rates.agreement(spark.createDataFrame(pairs, "a string, b string"), [], "a", "b", "PASS").first()
    observed, pe = 18 / 25, (13 * 14 + 12 * 11) / 625
    assert (row["n"], row["agree"], row["label_only"], row["verdict_only"], row["unparsed"]) == (26, 18, 3, 4, 1)
    assert abs(row["kappa"] - (observed - pe) / (1 - pe)) < 1e-6
    same = rates.agreement(spark.createDataFrame([("PASS", "PASS")] * 3, "a string, b string"), [], "a", "b", "PASS").first()
    assert same["kappa"] is None and same["pct"] == 100


def test_reports_on_empty_tables(spark):
    none = spark.createDataFrame([], "m string, p boolean, l array<string>")
    assert [tuple(r) for r in rates.label_counts(none, F.col("l"), ["x"]).collect()] == [("x", 0, 0.0)]
    assert [r["n"] for r in rates.taxonomy(none, {"a": F.col("p")}, "m").collect()] == [0]
    assert rates.share_of_total(spark.createDataFrame([], "g string, v int"), "g", "v").collect() == []


def test_rollup_counts_null_group_apart_from_all(spark):
    rows = [("x", True), ("x", False), (None, True)]
    got = {(r["m"], r["level"]): (r["n"], r["passed"]) for r in rates.pass_rates(spark.createDataFrame(rows, "m string, p boolean"), "m", "p").collect()}
    assert got == {("x", 0): (2, 1), (None, 0): (1, 1), ("ALL", 1): (3, 2)}


def test_flips_deltas_hits(spark):
    a = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, ok boolean")
    b = spark.createDataFrame([(1, False), (2, True), (3, False), (4, True)], "k int, ok boolean")
    assert {tuple(r) for r in rates.flips(a, b, "k", "ok").collect()} == {(1, "broken"), (2, "fixed")}
    x, y = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double"), spark.createDataFrame([("b", 2.0), ("c", 5.0)], "k string, v double")
    assert {(r["k"], r["change"]) for r in rates.deltas(x, y, "k", "v").collect()} == {("a", "down"), ("b", "same"), ("c", "up")}
    row = rates.hit_rates(spark.createDataFrame([(1,), (3,), (9,), (None,)], "r int"), [], "r", 3).first()
    assert (row["n"], row["hits"], row["hit_rate"], row["hit_at_1"]) == (4, 2, 0.5, 0.25) and abs(row["mrr"] - (1 + 1 / 3) / 4) < 1e-6


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.sampled_from([1, 25, 50, 90, 99, 100]))
def test_nearest_rank_covers_its_percentage(values, p):
    v = sorted(values)
    pick = v[max(1, math.ceil(p / 100 * len(v) - 1e-12)) - 1]
    assert sum(x <= pick for x in v) >= p / 100 * len(v) - 1e-9


@pytest.mark.parametrize("n", [0, 1, 3])
def test_percent_of_nothing(spark, n):
    got = spark.range(1).select(rates.percent(F.lit(1), F.lit(n)).alias("p")).first()["p"]
    assert got == pytest.approx(0 if n == 0 else 100 / n)
