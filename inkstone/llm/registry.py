"""The opN_ queries and the SQL that must give the same rows."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    """QUERIES and ORACLE_SQL of every module of this package that has them."""
    todo: dict[str, Callable] = {}
    sql: dict[str, str] = {}
    package = importlib.import_module("inkstone.llm")
    for info in sorted(pkgutil.iter_modules(package.__path__), key=lambda m: m.name):
        if info.name != "registry":
            module = importlib.import_module(f"inkstone.llm.{info.name}")
            todo |= getattr(module, "QUERIES", {})
            sql |= getattr(module, "ORACLE_SQL", {})
    return todo, sql
