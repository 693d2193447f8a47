"""Named queries over the driver's tables, with the SQL that checks each of them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

#: Modules that hold QUERIES (name -> function of spark and folder) and ORACLE (name -> DuckDB SQL).
MODULES = ("scalars", "tables", "pagequeries")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"pagewright.plans.{name}"), what))
    return out


def queries() -> dict[str, Callable]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
