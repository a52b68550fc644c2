"""Registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Modules with QUERIES (name -> function of session and folder) and SQL (name -> the same rows in DuckDB).
_MODULES = ("queries_text",)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in _MODULES for k, q in importlib.import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in importlib.import_module(f"{__package__}.{m}").SQL.items()}
