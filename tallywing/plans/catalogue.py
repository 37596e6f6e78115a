"""All registered queries."""

from __future__ import annotations

from tallywing.plans import (
    ingest_queries, people_queries, quality_queries, science_queries, usage_queries)
from tallywing.plans.registry import Query


def all_queries() -> dict[str, Query]:
    merged: dict[str, Query] = {}
    for module in (people_queries, usage_queries, quality_queries, science_queries,
                   ingest_queries):
        for name, query in module.CASES.items():
            if name in merged:
                raise ValueError(f"query {name!r} is registered twice")
            merged[name] = query
    return merged
