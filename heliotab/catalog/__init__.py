"""Registered queries over the benchmark tables and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

from heliotab.catalog.registry import ORACLES, QUERIES

MODULES = ("columns", "readers", "joined", "totals", "ordered", "streams", "composed")


def all_queries():
    """The dictionaries of queries and of their SQL."""
    for name in MODULES:
        import_module(f"heliotab.catalog.{name}")
    return dict(QUERIES), dict(ORACLES)
