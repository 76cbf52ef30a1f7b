"""Named, pluggable functions: retrievers, checks and tools that answer with a value or an error."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import json_object, same_hyphens

#: What every tool gives back.
ENVELOPE = "struct<value: string, error: string>"


class ToolRegistry:
    """Tools by name, each with the arguments it needs; unknown names, bad arguments and
    exceptions are error values, never failures of the job."""

    def __init__(self) -> None:
        self.tools: dict[str, tuple[Callable[..., Any], frozenset[str]]] = {}

    def tool(self, name: str, *needs: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
        def keep(f: Callable[..., Any]) -> Callable[..., Any]:
            if name in self.tools:
                raise ValueError(f"two tools are named {name}")
            self.tools[name] = (f, frozenset(needs))
            return f

        return keep

    def answer(self, name: str | None, args: str | None) -> tuple[str | None, str | None]:
        if name not in self.tools:
            return None, f"unknown tool {name}"
        f, needs = self.tools[name]
        try:
            given = json.loads(args or "{}")
            given = json.loads(given) if isinstance(given, str) else given
        except ValueError:
            return None, "bad arguments: not JSON"
        if not isinstance(given, dict) or not needs <= given.keys():
            return None, f"bad arguments: {', '.join(sorted(needs))} needed"
        try:
            return json.dumps(f(**given), sort_keys=True), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    def column(self, name: Column, args: Column) -> Column:
        """The tools as an Arrow UDF over (name, args) columns."""
        registry = self

        @F.pandas_udf(ENVELOPE)
        def call(names: pd.Series, texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([registry.answer(n, a) for n, a in zip(names, texts, strict=True)], columns=["value", "error"])

        return call(name, args)

    def register(self, spark: SparkSession, sql_name: str) -> None:
        """Makes ``sql_name(tool, args)`` known to SQL."""
        registry = self

        @F.pandas_udf(ENVELOPE)
        def call(names: pd.Series, texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([registry.answer(n, a) for n, a in zip(names, texts, strict=True)], columns=["value", "error"])

        spark.udf.register(sql_name, call)

    def listing(self, spark: SparkSession) -> DataFrame:
        rows = [(n, sorted(needs)) for n, (_, needs) in sorted(self.tools.items())]
        return spark.createDataFrame(rows, "tool string, needs array<string>")


def run_checks(df: DataFrame, checks: Mapping[str, tuple[Column, Column]], out: str = "checks") -> DataFrame:
    """``df`` with an array of ``(name, passed, detail)``; a null test has not passed."""
    rows = [F.struct(F.lit(n).alias("name"), F.coalesce(test, F.lit(False)).alias("passed"), detail.cast("string").alias("detail")) for n, (test, detail) in checks.items()]
    return df.withColumn(out, F.array(*rows))


def expect_check(position: Column, grounds: Column, position_not: Column, position_in: Column, must_cite: Column) -> Column:
    """``(ok, why)`` of an answer under what a case expects: positions forbidden, positions
    allowed, codes of which one must be cited.  Null or empty lists expect nothing; the first
    expectation not met is the reason."""
    said, cited = F.upper(F.coalesce(position, F.lit(""))), same_hyphens(F.coalesce(grounds, F.lit("")))
    given = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    why = (
        F.when(~(given(position_not) | given(position_in) | given(must_cite)), "nothing expected")
        .when(given(position_not) & F.array_contains(position_not, said), "position forbidden")
        .when(given(position_in) & ~F.array_contains(position_in, said), "position not allowed")
        .when(given(must_cite) & ~F.exists(must_cite, lambda c: F.contains(cited, c)), "no code cited")
        .otherwise("as expected")
    )
    return F.struct(why.isin("nothing expected", "as expected").alias("ok"), why.alias("why"))


def validated(reply: Column, needs: Sequence[str], numbers: Sequence[str] = ()) -> Column:
    """``(value, error)`` of a model's reply that should hold a JSON object, from its first brace
    to its last: the object's text, or what is wrong with it.  ``needs`` are keys it must have,
    those in ``numbers`` with a number or null."""
    text = json_object(reply)
    doc = F.try_parse_json(text)
    keys = F.json_object_keys(text)
    missing = F.array_except(F.array(*map(F.lit, needs)), F.coalesce(keys, F.array().cast("array<string>")))
    odd = F.lit(None).cast("string")
    for key in reversed(numbers):
        kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{key}", "variant"))
        odd = F.when(kind.isNotNull() & ~kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*|VOID)$"), F.concat(F.lit(key), F.lit(" is no number"))).otherwise(odd)
    error = (
        F.when(F.coalesce(F.trim(reply), F.lit("")) == "", "empty reply").when(text.isNull(), "no JSON object").when(doc.isNull(), "invalid JSON")
        .when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), F.array_join(missing, ", "))).otherwise(odd)
    )
    return F.struct(F.when(error.isNull(), text).alias("value"), error.alias("error"))
