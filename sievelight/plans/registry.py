"""Registered queries of the scan jobs and their SQL."""

from __future__ import annotations

from sievelight.plans import finding_queries, scan_queries

_MODULES = [scan_queries, finding_queries]
flagship = scan_queries.flagship


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.R.queries.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.R.sql.items()}
