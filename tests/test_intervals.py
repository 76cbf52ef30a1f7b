import random

from pyspark.sql import functions as F

from tidemark.operators.intervals import merge_intervals

KIND = "e string, a int, b int"


def brute(rows):
    days = {}
    for e, a, b in rows:
        if e is not None and a is not None and b is not None and a <= b:
            days.setdefault(e, set()).update(range(a, b + 1))
    out = set()
    for e, covered in days.items():
        runs, last = [], None
        for x in sorted(covered):
            if last is None or x > last + 1:
                runs.append([x, x])
            runs[-1][1] = last = x
        out |= {(e, "period", a, b) for a, b in runs}
        out |= {(e, "gap", p[1] + 1, q[0] - 1) for p, q in zip(runs, runs[1:])}
    return out


def run(spark, rows, partitions=4):
    return {tuple(r) for r in merge_intervals(spark.createDataFrame(rows, KIND), "e", "a", "b", partitions).collect()}


def test_touching_nested_and_apart(spark):
    rows = [("x", 1, 5), ("x", 6, 8), ("x", 2, 3), ("x", 10, 12), ("y", 1, 1), ("x", 1, 5), ("x", 9, 8), ("x", None, 4), ("x", 4, None), (None, 1, 2)]
    assert run(spark, rows) == {("x", "period", 1, 8), ("x", "gap", 9, 9), ("x", "period", 10, 12), ("y", "period", 1, 1)}


def test_random_against_brute_force(spark):
    r = random.Random(1)
    for n in (40, 300):
        rows = [(r.choice("abc") if r.random() < 0.5 else "hot", a := r.randint(-50, 400), a + r.randint(-1, 12)) for _ in range(n)]
        assert run(spark, rows, 7) == brute(rows)


def test_one_entity_over_many_partitions_with_a_long_first_interval(spark):
    rows = [("hot", 0, 5000), *(("hot", i * 10, i * 10 + 3) for i in range(600))]
    assert run(spark, rows, 8) == brute(rows)


def test_open_end_and_extra_columns(spark):
    df = spark.createDataFrame([("x", 1, 2932896), ("x", 5, 6)], KIND).withColumn("s", F.lit("z")).withColumn("part", F.lit(1)).withColumn("entity", F.lit("q"))
    assert [tuple(r) for r in merge_intervals(df, "e", "a", "b").collect()] == [("x", "period", 1, 2932896)]


def test_empty(spark):
    assert run(spark, []) == set()
