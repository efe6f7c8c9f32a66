"""All queries of the catalogue engine with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package that hold queries: name to (function, SQL or None).
GROUPS = ("usage", "browse", "history", "storage", "content", "lifecycle", "streams")


def _all() -> dict[str, tuple]:
    every: dict[str, tuple] = {}
    for name in GROUPS:
        every |= import_module(f"bytecairn.plans.{name}").QUERIES
    return every


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s is not None}
