"""All queries of the library and their SQL counterparts."""

from __future__ import annotations

from sparsewright.plans import graph_queries, layer_queries, matrix_queries, more_queries, object_queries
from sparsewright.plans.session import shipped

_PARTS = [matrix_queries, graph_queries, more_queries, object_queries, layer_queries]
QUERIES: dict = {name: shipped(f) for part in _PARTS for name, f in part.QUERIES.items()}
SQL: dict = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
flagship = QUERIES["region_top_features"]
