"""The engine's registered queries and their SQL."""

from __future__ import annotations

from lexmill.plans import more_queries, record_queries, report_queries, retrieval_queries  # noqa: F401
from lexmill.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
