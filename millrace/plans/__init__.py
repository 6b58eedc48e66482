"""Registered queries of estimators and preparation, with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("estimators", "preparation", "steps", "guides", "factoring", "boosted", "linkage", "chained")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").ORACLE.items()}
