"""Query name to builder, and query name to the SQL that must give the same rows."""

from __future__ import annotations

from lorewright.plans import (  # noqa: F401  (importing registers the queries)
    dataset_queries,
    evaluation_queries,
    graph_queries,
    stage_queries,
    text_queries,
)
from lorewright.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
