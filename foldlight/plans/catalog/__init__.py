"""Registered queries over the given tables, each with its SQL where one exists."""

from __future__ import annotations

from importlib import import_module

from foldlight.plans.catalog.registry import ORACLE, QUERIES

for _module in (
    "samples",
    "reshaping",
    "scores",
    "curves",
    "statistics",
    "transforms",
    "patterns",
    "estimators",
    "checked_models",
    "checked_selection",
    "checked_factors",
    "checked_trees",
    "files",
    "streams",
):
    import_module(f"foldlight.plans.catalog.{_module}")

__all__ = ["ORACLE", "QUERIES"]
