"""Parquet tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """One table.  A narrower ``schema`` prunes nested fields at the scan, which
    Catalyst cannot do below higher-order functions or Python operators."""
    reader = spark.read
    if schema:
        reader = reader.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")
