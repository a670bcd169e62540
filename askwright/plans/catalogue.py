"""All queries of the engine's own operators, with the SQL that checks each."""

from __future__ import annotations

from askwright.plans import corpus, extra, funnel, graph, itsm, measure, more, proposals, rank, retrieve, route, selection, sources, stream, texts  # noqa: F401  (they register)
from askwright.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
