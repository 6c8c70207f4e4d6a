"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("navigator", "graph", "findings", "clones", "symbols", "related", "lifecycle", "texts", "reports", "listings", "flows", "symbol_trees", "semantic", "investigations", "abi", "relatedness", "composed", "doctor")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"quarry.operators.{_name}")
    QUERIES |= _module.REGISTRY.queries
    ORACLE_SQL |= _module.REGISTRY.sql
