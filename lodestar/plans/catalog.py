"""Registered queries of the search and curation operators, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from lodestar.plans import aggregates, ingest, joins, management, refinement, search, streams  # noqa: F401
from lodestar.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark, sf_dir):
    """Filtered top-10 cosine search with result envelope."""
    return QUERIES["search_flagship"](spark, sf_dir)
