"""Queries and oracle SQL of the discovery engine, by name."""

from __future__ import annotations

from lacuna.plans import queries as _queries


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_queries.ORACLES)
