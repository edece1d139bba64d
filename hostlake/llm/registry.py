"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("simhash", "gif", "toxicity", "quotes", "pstable", "pieces", "language", "mixing", "substring", "quality", "repair", "divergence", "blocks")


def _gather(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(import_module(f"hostlake.llm.{module}"), name, {})
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
