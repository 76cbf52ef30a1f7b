import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.keys import clean_key
from tidemark.operators.joins import salted_join
from tidemark.operators.references import find_orphans, orphan_counts, reference_targets

T = lambda day: dt.datetime(2024, 1, day)
REFS = "src string, rec_id string, target string, ref string, at timestamp"
ROWS = "key string, first_at timestamp, gone timestamp"


@pytest.fixture()
def targets(spark):
    rows = [("A", T(5), None), ("A", T(3), None), ("B", T(1), T(10)), ("B", T(1), None), (None, T(1), None)]
    return reference_targets(spark.createDataFrame(rows, ROWS), "t", "key", "first_at", "gone")


def found(df):
    return {tuple(r) for r in df.collect()}


def test_kinds_periods_and_copies(spark, targets):
    rows = [("s", "1", "t", "A", T(2)), ("s", "1", "t", "A", T(2)), ("s", "2", "t", "A", T(4)), ("s", "3", "t", "B", T(10)), ("s", "4", "t", "B", T(9)), ("s", "5", "t", "C", T(1)), ("s", "6", "t", None, T(1)), ("s", "7", "t", "C", None)]
    got = found(find_orphans(spark.createDataFrame(rows, REFS), targets))
    assert got == {("s", "1", "A", "late", "2024-01"), ("s", "3", "B", "deleted", "2024-01"), ("s", "5", "C", "missing", "2024-01"), ("s", "7", "C", "missing", None)}


def test_target_tables_are_kept_apart(spark, targets):
    rows = [("s", "1", "other", "A", T(4))]
    assert found(find_orphans(spark.createDataFrame(rows, REFS), targets)) == {("s", "1", "A", "missing", "2024-01")}


def test_hot_key_and_clashing_columns(spark, targets):
    rows = [("s", str(i), "t", "GONE", T(1)) for i in range(500)] + [("s", f"x{i}", "t", f"K{i}", T(1)) for i in range(300)]
    refs = spark.createDataFrame(rows, REFS).withColumn("kind", F.lit("x")).withColumn("first_at", F.lit(1)).withColumn("_salt", F.lit(2))
    got = find_orphans(refs, targets.withColumn("n", F.lit(0)))
    counts = orphan_counts(got).collect()
    assert [(r["kind"], r["n_refs"], r["n_records"], r["n_keys"]) for r in counts] == [("missing", 800, 800, 301)]


def test_empty_tables(spark, targets):
    empty = spark.createDataFrame([], REFS)
    assert found(find_orphans(empty, targets)) == set()
    one = spark.createDataFrame([("s", "1", "t", "A", T(4))], REFS)
    assert found(find_orphans(one, targets.limit(0))) == {("s", "1", "A", "missing", "2024-01")}


def test_clean_key(spark):
    rows = [("  hm‑1 ",), ("\tHM−1\n",), ("",), ("  ",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "k string").select(clean_key(F.col("k"))).collect()]
    assert got == ["HM-1", "HM-1", None, None, None]


def test_salted_join_is_a_join(spark):
    facts = spark.createDataFrame([(k, i) for i in range(200) for k in ("hot" if i % 3 else f"k{i}",)], "k string, i int")
    dim = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    plain, salted = facts.join(dim, ["k"], "left"), salted_join(facts, dim, ["k"], ["hot"], F.col("i"), 4, "left")
    assert sorted(map(str, plain.select("k", "i", "v").collect())) == sorted(map(str, salted.select("k", "i", "v").collect()))
