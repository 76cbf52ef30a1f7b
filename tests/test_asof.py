import random

from pyspark.sql import functions as F

from tidemark.operators.asof import asof_lookup

EV, VE = "entity string, at int", 'entity string, start int, end int, known int, rank bigint, what string'


def brute(events, versions):
    out = set()
    for e, at in set(events):
        fit = [v for v in versions if v[0] == e and None not in (e, at, v[1], v[3]) and v[1] <= at and (v[2] is None or v[2] >= at) and v[3] <= at]
        if fit:
            out.add((e, at, max(fit, key=lambda v: (v[1], v[4], f'{{"_p0":"{v[5]}"}}'))[5]))
    return out


def run(spark, events, versions, **kw):
    return {tuple(r) for r in asof_lookup(spark.createDataFrame(events, EV), spark.createDataFrame(versions, VE), ["what"], **kw).collect()}


def test_never_with_what_became_known_later(spark):
    versions = [("p", 0, 100, 50, 1, "late"), ("p", 0, 100, 10, 0, "first"), ("p", 60, 80, 0, 0, "inner"), ("p", 90, None, 95, 0, "open"), ("p", None, 5, 0, 0, "x"), ("p", 0, 100, None, 9, "y")]
    events = [("p", 5), ("p", 20), ("p", 55), ("p", 70), ("p", 85), ("p", 94), ("p", 500), ("q", 5), (None, 5), ("p", None)]
    got = run(spark, events, versions)
    assert got == {("p", 20, "first"), ("p", 55, "late"), ("p", 70, "inner"), ("p", 85, "late"), ("p", 94, "late"), ("p", 500, "open")} == brute(events, versions)


def test_random_against_brute_force(spark):
    r = random.Random(3)
    for hot in (False, True):
        name = lambda: "hot" if hot and r.random() < 0.7 else r.choice("abcdef")
        versions = [(name(), s := r.randint(0, 900), s + r.randint(0, 300) if r.random() < 0.9 else None, r.randint(0, 1000), r.randint(0, 3), f"v{i:04}") for i in range(800)]
        events = [(name(), r.randint(-10, 1200)) for _ in range(600)]
        assert run(spark, events, versions, block_days=100) == brute(events, versions)


def test_ties_repeats_and_empty(spark):
    versions = [("p", 1, 9, 0, 0, "a"), ("p", 1, 9, 0, 0, "b"), ("p", 1, 9, 0, 0, "b")]
    assert run(spark, [("p", 3), ("p", 3)], versions) == {("p", 3, "b")}
    assert run(spark, [], versions) == set()
    assert run(spark, [("p", 3)], []) == set()


def test_clashing_payload_names(spark):
    versions = spark.createDataFrame([("p", 1, 9, 0, 0, "a")], VE).withColumn("block", F.lit(7)).withColumn("tie", F.array(F.lit(1)))
    got = asof_lookup(spark.createDataFrame([("p", 3)], EV), versions, ["start", "rank", "block", "tie"])
    assert [tuple(r) for r in got.collect()] == [("p", 3, 1, 0, 7, [1])]


def test_a_far_day_costs_one_block(spark):
    far = 2_932_896  # 9999-12-31
    versions = [(f"p{i}", 10, None, 10, 0, "v") for i in range(50)]
    events = [(f"p{i}", 100 + i) for i in range(50)] + [("p7", far), ("p8", -700_000)]
    got = asof_lookup(spark.createDataFrame(events, EV), spark.createDataFrame(versions, VE), ["what"])
    assert {tuple(r) for r in got.collect()} == brute(events, versions) and ("p7", far, "v") in brute(events, versions)
    plan = got._jdf.queryExecution().toString()
    assert "sequence(" not in plan
