"""All queries of the survey operators."""

from __future__ import annotations

from . import policy_queries, raster_queries, rule_queries, survey_queries

MODULES = (raster_queries, survey_queries, policy_queries, rule_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
