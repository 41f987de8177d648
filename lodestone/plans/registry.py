"""The engine's queries on the driver tables and the SQL they are held against."""

from __future__ import annotations

import importlib
import pkgutil

from lodestone.plans import groups


def _modules():
    return [importlib.import_module(f"{groups.__name__}.{m.name}") for m in pkgutil.iter_modules(groups.__path__)]


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
