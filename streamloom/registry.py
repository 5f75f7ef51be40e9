"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from streamloom.plans import queries as plans


def queries() -> dict:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(plans.ORACLES)
