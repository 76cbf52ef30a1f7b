import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark, sizes, seed=1):
    r = random.Random(seed)
    rows = [(i, s, max(0, int(r.lognormvariate(5, 0.7)))) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens int")


def test_flight_keeps_size_and_count():
    rng = np.random.default_rng(0)
    size = rng.integers(10, 500, 400).astype(float)
    p = np.full(400, 0.3)
    out = mixing.flight(p, size, random.Random(1))
    still = (out > 1e-9) & (out < 1 - 1e-9)
    assert still.sum() <= 2
    assert abs((out * size).sum() - (p * size).sum()) < 1e-6 and abs(out.sum() - p.sum()) < 1e-6


def test_chances_are_kept_on_average():
    size = np.array([5.0, 9.0, 20.0, 7.0, 7.0, 3.0, 11.0, 8.0])
    p = np.array([0.2, 0.5, 0.3, 0.7, 0.4, 0.6, 0.5, 0.8])
    mean = np.mean([mixing.flight(p, size, random.Random(i)) for i in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


def test_shares_caps_and_report(spark):
    docs = corpus(spark, {"big": 3000, "mid": 600, "small": 60, "other": 500}).withColumn("copies", F.lit(1)).withColumn("chance", F.lit(2))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("gone", 0.1, 2)], TARGETS)
    mixed, plan = mixing.mix_sources(docs, targets, block=250)
    rows = mixed.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and {r["source"] for r in rows} == {"big", "mid", "small"}
    report = {r["source"]: r for r in mixing.reached_shares(mixed, plan).collect()}
    for source, want, cap in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)):
        assert abs(report[source]["actual_share"] - want) < 0.01
        assert report[source]["most_repeats"] <= cap
    assert report["gone"]["actual_share"] == 0 and report["gone"]["copies"] == 0
    again, _ = mixing.mix_sources(docs, targets, block=250)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_a_smaller_total(spark):
    docs = corpus(spark, {"big": 2000, "mid": 900})
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.5, 2)], TARGETS)
    mixed, _ = mixing.mix_sources(docs, targets, total=60_000)
    got = {r["source"]: r["t"] for r in mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    assert all(abs(t - 30_000) < 600 for t in got.values())


def shares_of(spark, sizes, targets):
    """What each source is off by of its target, and the report, of documents of the given sizes."""
    rows = [(i, s, x) for i, (s, x) in enumerate((s, x) for s, xs in sizes.items() for x in xs)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, tokens int")
    report = {r["source"]: r for r in mixing.reached_shares(*mixing.mix_sources(docs, spark.createDataFrame(targets, TARGETS))).collect()}
    return {s: report[s]["actual_share"] / w - 1 for s, w, _ in targets}, report


def test_a_source_of_a_few_documents_has_its_share(spark):
    few = {"big": [90, 110, 100, 120] * 300, "few": [400, 300, 250, 350, 200, 150]}
    off, report = shares_of(spark, few, [("big", 0.995, 1), ("few", 0.005, 1)])
    assert max(map(abs, off.values())) < 0.011 and report["big"]["tokens"] > 120_000


def test_a_dominant_document_is_drawn_or_made_up_for(spark):
    half = {"giant": [50_000] + [50] * 1000, "other": [100] * 800}
    off, report = shares_of(spark, half, [("giant", 0.5, 1), ("other", 0.5, 1)])
    assert max(map(abs, off.values())) < 0.011 and report["other"]["tokens"] > 79_000
    many = {"giant": [500_000] + [100] * 5000, "other": [100] * 8000}  # more documents than a hand
    off, report = shares_of(spark, many, [("giant", 0.5, 1), ("other", 0.5, 1)])
    assert max(map(abs, off.values())) < 0.011 and report["other"]["tokens"] > 790_000


def test_a_total_that_cannot_be_had_shrinks(spark):
    """Whole repeats of one document: 1.6 of them cannot be had, one can, for the other half its part."""
    off, report = shares_of(spark, {"one": [1000], "other": [10] * 160}, [("one", 0.5, 2), ("other", 0.5, 1)])
    assert max(map(abs, off.values())) < 0.011 and report["one"]["tokens"] == 1000 and 990 <= report["other"]["tokens"] <= 1010
    gap = {"giant": [900_000] + [20] * 5000, "other": [100] * 5000}  # 0.5 of it is neither with nor without the giant
    off, report = shares_of(spark, gap, [("giant", 0.5, 1), ("other", 0.5, 1)])
    assert max(map(abs, off.values())) < 0.011 and report["giant"]["tokens"] > 99_000


def test_a_share_worth_few_documents_of_many(spark):
    sizes = {"big": [100] * 3000, "many": [300 + i % 301 for i in range(5000)]}
    off, _ = shares_of(spark, sizes, [("big", 0.995, 1), ("many", 0.005, 1)])
    assert max(map(abs, off.values())) < 0.011


def test_a_hand_keeps_the_chance_on_average():
    hand = mixing.Hand([40 + 7 * i % 113 for i in range(40)], 0)
    drawn = np.array([hand.draw(0.4, random.Random(i)) for i in range(600)])
    assert np.abs(drawn @ hand.size / (0.4 * hand.size.sum()) - 1).max() <= 0.005
    assert np.abs(drawn.mean(axis=0) - 0.4).max() < 0.15  # landing shifts it a little


def test_odd_tables(spark):
    targets = spark.createDataFrame([("a", 1.0, 2), (None, 0.5, 1), ("b", None, 1), ("c", 0.2, None)], TARGETS)
    docs = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "b", 5), (4, "a", 0)], "doc_id bigint, source string, tokens int")
    mixed, plan = mixing.mix_sources(docs, targets)
    assert {(r["doc_id"], r["copies"]) for r in mixed.collect()} == {(1, 2), (4, 2)}
    assert mixing.mix_sources(docs.limit(0), targets)[0].collect() == []
    assert mixing.mix_sources(docs, targets.limit(0))[0].collect() == []


def test_clean_source(spark):
    rows = [("Run-Logs ",), (" run logs",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(mixing.clean_source(F.col("s"))).collect()]
    assert got == ["run_logs", "run_logs", None, None]
