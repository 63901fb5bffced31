"""Queries over the shared tables, each with its SQL counterpart."""

from __future__ import annotations

from importlib import import_module

from geomill.plans.registry import ORACLES, QUERIES

MODULES = ("assets", "copying", "series", "spatial", "paths", "network", "roads", "structures", "raster", "messages")


def all_queries() -> tuple[dict, dict]:
    """(queries, SQL counterparts) of every module in MODULES."""
    for name in MODULES:
        import_module(f"geomill.plans.{name}")
    return QUERIES, ORACLES
