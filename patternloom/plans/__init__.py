"""Registered queries over the standard tables, and DuckDB SQL that says the same."""

from __future__ import annotations

from importlib import import_module

from patternloom.plans import registry

for _name in ("tables", "sequences"):
    import_module(f"patternloom.plans.{_name}")


def queries() -> dict:
    return registry.QUERIES


def oracle_sql() -> dict:
    return registry.SQL
