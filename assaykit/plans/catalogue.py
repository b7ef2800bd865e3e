"""All queries of the evaluation engine with their SQL for an independent engine."""

from __future__ import annotations

from . import artifact_queries, pairing_queries, report_queries, run_queries, scoring_queries, text_queries

MODULES = (scoring_queries, pairing_queries, text_queries, report_queries, run_queries, artifact_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.registry.sql.items()}
