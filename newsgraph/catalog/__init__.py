"""Registered queries.  Each module holds QUERIES (name -> callable) and ORACLE (name -> SQL)."""

from __future__ import annotations

import importlib

MODULES = ["scalars", "scores", "sets", "graphs", "feeds", "landings"]


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(importlib.import_module(f"newsgraph.catalog.{name}"), attribute))
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
