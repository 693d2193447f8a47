"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("chat", "jaccard", "decontaminate", "langid", "covertree", "styletree", "licenses", "pieces", "suffixdedup", "chaining", "packing", "repair", "ranking")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"pagewright.llm.{name}"), what))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
