"""The desk's queries on odd tables: empty ones, rows of nulls, further columns."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.plans import desk

DATA = "/root/testdata/sf0.001"
TABLES = "chunks policies claims suite_v2_attempt race_single traj_before eval_before".split()
FOUND = ["p1_found", "p3_found", "p4_found", "p6_found"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows(spark, name, folder):
    return sorted(map(str, (tuple(r) for r in desk.REGISTRY[name].plan(spark, folder).collect())))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Every row twice, rows of nulls, and columns whose names the operators use themselves."""
    out = str(tmp_path_factory.mktemp("odd"))
    for t in TABLES:
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        nulls = spark.range(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields))
        extra = [F.lit(i).alias(n) for i, n in enumerate(("ref", "entity", "s", "e", "part", "rank", "src", "key", "day", "form", "lvl1")) if n not in df.columns]
        df.unionByName(df).unionByName(nulls).select("*", *extra).write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{out}/{t}.parquet")
    return out


@pytest.mark.parametrize("name", FOUND)
def test_copies_nulls_and_further_columns_change_nothing(spark, odd, name):
    want = rows(spark, name, DATA)
    assert want and rows(spark, name, odd) == want


@pytest.mark.parametrize("name", [*FOUND, "p1_counts", "p3_levels"])
def test_empty_tables(spark, empty, name):
    assert rows(spark, name, empty) == []
