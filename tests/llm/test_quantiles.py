import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quantiles as q

QS = [0.01, 0.25, 0.5, 0.9, 0.99]


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(4)
    parts = {"heavy": rng.lognormal(0, 2, 30_000), "peaks": np.concatenate([rng.normal(1, 0.01, 5000), rng.normal(900, 5, 5000)]), "ties": rng.integers(0, 9, 8000) / 2.0, "tiny": np.array([3.0, 1.0, 2.0]), "negative": rng.normal(-5, 3, 9000)}
    return pd.concat([pd.DataFrame({"arm": k, "v": v}) for k, v in parts.items()], ignore_index=True).assign(id=lambda d: range(len(d)))


def rank_error(data, value, p):
    code, want = np.sort(q.encode_values(data)), max(np.ceil(p * len(data)), 1)
    c = q.encode_values(np.array([value]))[0]
    lo, hi = np.searchsorted(code, c, "left") + 1, np.searchsorted(code, c, "right")
    return max(lo - want, want - hi, 0) / len(data)


def test_rank_error_is_within_the_bound(spark, values):
    sketch = q.build_sketch(spark.createDataFrame(values), ["arm"], "v")
    rows = q.sketch_percentiles(sketch, QS).collect()
    assert len(rows) == 5 * len(QS)
    for r in rows:
        data = values.loc[values.arm == r["arm"], "v"].to_numpy()
        assert r["n"] == len(data)
        assert rank_error(data, r["value"], r["q"]) <= r["rank_error"] + 1 / len(data) and r["rank_error"] < 0.05


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("shape", ["even", "narrow", "ties", "spike", "wide", "few"])
def test_bound_of_each_group_holds(shape, seed):
    rng, n = np.random.default_rng(seed), 60_000
    data = {
        "even": lambda: rng.integers(0, 6000, n) / 7.0 + 1,
        "narrow": lambda: 100 + rng.random(n) / 1000,
        "ties": lambda: rng.zipf(1.3, n).astype(float),
        "spike": lambda: np.where(rng.random(n) < 0.34, 5.0, rng.normal(5, 2, n)),
        "wide": lambda: rng.lognormal(0, 6, n) * rng.choice([-1, 1], n),
        "few": lambda: rng.normal(0, 1, 12),
    }[shape]()
    cells = np.zeros(q.CELLS, np.int64)
    q.add_values(cells, q.encode_values(data), np.ones(len(data)))
    ps = np.linspace(0.01, 0.99, 33)
    count, values, bounds = q.invert(cells, ps)
    assert count == len(data) and bounds.max() < 0.06
    for p, v, b in zip(ps, values, bounds, strict=True):
        assert rank_error(data, v, p) <= b + 1 / len(data)


def test_sketches_add_and_subtract(spark, values):
    df = spark.createDataFrame(values)
    sketch = lambda d: q.build_sketch(d, ["arm"], "v")
    cells = lambda s: {(r["arm"], r["cell"]): r["n"] for r in s.collect()}
    whole = cells(sketch(df))
    odd, even = df.where("id % 2 = 1"), df.where("id % 2 = 0")
    assert cells(q.merge_sketches(sketch(odd), sketch(even))) == whole
    minus = q.build_sketch(odd.withColumn("w", F.lit(-1)), ["arm"], "v", weight="w")
    assert cells(q.merge_sketches(sketch(df), minus)) == cells(sketch(even))


def test_codes_keep_order():
    x = np.array([-np.inf, -1e300, -2.5, -1e-9, 0.0, 1e-9, 0.1, 2.5, 2.5000001, 1e300, np.inf])
    assert (np.diff(q.encode_values(x).astype(np.int64)) >= 0).all()
    finite = x[1:-1]
    assert np.allclose(q.decode_values(q.encode_values(finite)), finite, rtol=2**-20, atol=0)


def test_missing_values_null_groups_and_names(spark):
    rows = [(None, 1.0, 1), (None, 1.0, 2), ("a", None, 3), ("a", float("nan"), 4), ("a", 0.0, 5), ("b", float("nan"), 6)]
    df = spark.createDataFrame(rows, "arm string, v double, id int").withColumn("g", F.lit(1)).withColumn("w", F.lit("x")).withColumn("n", F.lit(9))
    got = {r["arm"]: (r["value"], r["n"]) for r in q.sketch_percentiles(q.build_sketch(df, ["arm"], "v"), [0.5]).collect()}
    assert set(got) == {None, "a"} and got["a"] == (0.0, 1) and abs(got[None][0] - 1) < 1e-5
    assert q.build_sketch(df.limit(0), ["arm"], "v").collect() == []
