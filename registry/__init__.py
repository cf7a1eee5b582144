"""Queries over the given tables, one or more per operator, with their SQL."""

from __future__ import annotations

import importlib

MODULES = ("sources", "profiles", "transforms", "series", "splits", "metrics", "reports", "models", "writes", "flows", "flagship")


def load():
    from registry.base import ORACLE, QUERIES

    for name in MODULES:
        try:
            importlib.import_module(f"registry.{name}")
        except ModuleNotFoundError as exc:
            if exc.name != f"registry.{name}":
                raise
    return dict(QUERIES), dict(ORACLE)
