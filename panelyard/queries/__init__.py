"""Adapter from the driver's tables to the operators: every query with the SQL that gives the same rows."""

from __future__ import annotations

from panelyard.queries import aggregates, checks, decisions, features, flows, opponents, players, scans, seasons
from panelyard.queries.base import REGISTRY

__all__ = ["aggregates", "checks", "decisions", "features", "flows", "opponents", "oracle_sql", "players", "queries", "scans", "seasons"]


def queries() -> dict:
    return {name: q.run for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
