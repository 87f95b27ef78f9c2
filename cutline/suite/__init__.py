"""All registered queries, one module per operator family."""

from __future__ import annotations

from importlib import import_module

FAMILIES = [
    "intervals", "sampling", "tone", "deltas", "planning", "forms", "text", "containers", "events",
]


def _modules():
    return [import_module(f"cutline.suite.{name}") for name in FAMILIES]


def queries():
    return {k: fn for m in _modules() for k, fn in m.QUERIES.items()}


def oracle_sql():
    return {k: sql for m in _modules() for k, sql in m.ORACLE.items()}
