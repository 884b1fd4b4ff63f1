"""Every query of the image-analytics operators, with SQL for comparison."""

from __future__ import annotations

from rasterflow import oracle, plane_oracle, plane_queries, queries

QUERIES = {**queries.QUERIES, **plane_queries.QUERIES}
ORACLE_SQL = {**oracle.oracle_sql(), **plane_oracle.oracle_sql()}

__all__ = ["ORACLE_SQL", "QUERIES"]
