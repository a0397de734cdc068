"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from techtrail.plans import files, histories, measures, scans, tables, together

MODULES = [histories, scans, tables, measures, together, files]


def queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in MODULES:
        found |= module.ORACLE
    return found
