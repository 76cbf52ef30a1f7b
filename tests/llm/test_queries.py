"""The training-data queries on odd tables."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries

DATA = "/root/testdata/sf0.001"
TABLES = "claims demo race_single documents subjects subject_labels mix_targets".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows(spark, name, folder):
    return sorted(map(str, (tuple(r) for r in queries.REGISTRY[name].plan(spark, folder).collect())))


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    odd, empty = str(tmp_path_factory.mktemp("odd")), str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        df.limit(0).write.parquet(f"{empty}/{t}.parquet")
        nulls = spark.range(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields))
        twice = df.unionByName(df) if t in ("claims", "demo", "race_single") else df
        nulls = nulls.limit(0) if t == "documents" else nulls
        extra = [F.lit(i).alias(n) for i, n in enumerate(("ids", "word", "k", "g", "cell", "n", "copies", "chance", "score", "areas", "item", "kind")) if n not in df.columns]
        twice.unionByName(nulls).select("*", *extra).write.parquet(f"{odd}/{t}.parquet")
    return odd, empty


@pytest.mark.parametrize("name", ["p5_found", "p7_ids", "p8_mix", "p9_found"])
def test_copies_nulls_and_further_columns_change_nothing(spark, folders, name):
    want = rows(spark, name, DATA)
    assert want and rows(spark, name, folders[0]) == want


def test_runs_count_once(spark, folders):
    """Copies change no percentile; three runs without an id are one more run without measurements."""
    assert rows(spark, "p2_percentiles", folders[0]) == rows(spark, "p2_percentiles", DATA)


@pytest.mark.parametrize("name", sorted(queries.REGISTRY))
def test_empty_tables(spark, folders, name):
    assert rows(spark, name, folders[1]) == []
