"""Text, JSON-lines and CSV sources and sinks with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """``(file, text)``: a row per file, whole."""
    found = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
    return found.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """JSON lines under a given schema; blank lines are skipped, bad ones kept in ``_corrupt``
    (or an error with ``strict``)."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def run_file(spark: SparkSession, path: str, header: str, rows: str) -> tuple[DataFrame, DataFrame]:
    """A run file's header row (``type = 'header'``) and its item rows, each under its schema."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    is_header = F.coalesce(F.get_json_object("value", "$.type") == "header", F.lit(False))
    parsed = lambda keep, schema: lines.where(keep).select(F.from_json("value", schema).alias("r")).select("r.*")
    return parsed(is_header, header), parsed(~is_header, rows)


def json_map(spark: SparkSession, path: str, value: str, key: str = "key") -> DataFrame:
    """A JSON document that maps keys to objects, as one row per key."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<{value}>>").alias("m"))
    return doc.select(F.explode("m").alias(key, "v")).select(key, "v.*")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that holds one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def day_log(spark: SparkSession, folder: str, schema: str, day: str | None = None) -> DataFrame:
    """A log partitioned by ``day``; naming a day reads its folder only."""
    rows = spark.read.schema(f"{schema}, day string").json(folder)
    return rows.where(F.col("day") == day) if day else rows


def append_day_log(df: DataFrame, folder: str, ts: str = "ts", checks: Sequence[tuple[str, Column]] = ()) -> None:
    """Append to the log, one folder per day of ``ts`` as written.

    ``checks`` are (message, condition) pairs; a row that fails one stops the write before
    anything is committed, so no unredacted row is ever stored.
    """
    for message, condition in checks:
        df = df.where(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
    df.withColumn("day", F.substring(ts, 1, 10)).write.partitionBy("day").mode("append").json(folder)


def write_csv(df: DataFrame, folder: str, digits: int = 6) -> None:
    """CSV with a header; floats rounded, arrays joined by ``'; '``."""
    cols = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        cols.append((F.concat_ws("; ", c) if kind == "array" else F.round(c, digits) if kind in ("double", "float") else c).alias(f.name))
    df.select(*cols).write.mode("overwrite").option("header", True).csv(folder)


def access_log(spark: SparkSession, path: str) -> DataFrame:
    """``(ts, token, tool, claim)`` of ``<ts> token=.. tool=.. claim=..`` lines; other lines are left out."""
    at = r"^(\S+) token=(\S+) tool=(\S+) claim=(\S+)\s*$"
    lines = spark.read.text(path).where(F.col("value").rlike(at))
    return lines.select(*(F.regexp_extract("value", at, i).alias(n) for i, n in enumerate(("ts", "token", "tool", "claim"), 1)))


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small report as a markdown table; larger results are an error, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), "|" + " --- |" * len(df.columns), *map(line, rows)])
