"""Named queries of the engine and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from vectorloom.plans import graph_queries, numeric_queries, relational_queries, scale_queries, topology_queries, vector_queries, workflow_queries
from vectorloom.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "graph_queries", "numeric_queries", "relational_queries", "scale_queries", "topology_queries", "vector_queries", "workflow_queries"]
