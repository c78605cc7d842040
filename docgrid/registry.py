"""The queries of the engine's own operators over the driver tables, and SQL that gives the same rows."""

from __future__ import annotations

from docgrid.plans import contract_queries, queries, run_queries, structure_queries

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

FLAGSHIP = "detect_profile"
QUERIES = {**queries.QUERIES, **structure_queries.QUERIES, **run_queries.QUERIES, **contract_queries.QUERIES}
ORACLE_SQL = {**queries.ORACLE_SQL, **structure_queries.ORACLE_SQL, **run_queries.ORACLE_SQL, **contract_queries.ORACLE_SQL}
