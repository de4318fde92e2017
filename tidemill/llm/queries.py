"""All queries of this package."""

from __future__ import annotations

from tidemill.llm import containers, distinct, quality
from tidemill.plans.registry import Registry

REGISTRY = Registry()
for _module in (distinct, containers, quality):
    REGISTRY.queries.update(_module.REGISTRY.queries)
    REGISTRY.sql.update(_module.REGISTRY.sql)
