"""All registered queries of the core."""

from __future__ import annotations

from tidemark.plans import boundaries, desk, library, privacy, reports, runs, tables
from tidemark.plans.registry import Registry

REGISTRY = Registry()
for module in (desk, runs, library, tables, boundaries, privacy, reports):
    for name, query in module.REGISTRY.items():
        REGISTRY.add(name, query.sql)(query.plan)
