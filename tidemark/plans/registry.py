"""Named queries with, where SQL can express them, their oracle."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Query(NamedTuple):
    plan: Plan
    sql: str | None


class Registry(dict[str, Query]):
    def add(self, name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
        def keep(plan: Plan) -> Plan:
            if name in self:
                raise ValueError(f"{name} is registered twice")
            self[name] = Query(plan, sql)
            return plan

        return keep

    def plans(self) -> dict[str, Plan]:
        return {name: q.plan for name, q in self.items()}

    def oracles(self) -> dict[str, str]:
        return {name: q.sql for name, q in self.items() if q.sql}
