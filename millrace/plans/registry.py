"""All queries of the core, with the SQL they are checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("selection", "star", "quality", "windows", "scalars", "risk", "metrics", "compare", "graph", "profile", "events", "corpus")


@cache
def _all() -> tuple[dict[str, Query], dict[str, str]]:
    found: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for name in MODULES:
        module = importlib.import_module(f"millrace.plans.{name}")
        for key, query in module.QUERIES.items():
            if key in found:
                raise ValueError(f"two queries are named {key}")
            found[key] = query
        sql.update(module.SQL)
    return found, sql


def queries() -> dict[str, Query]:
    return dict(_all()[0])


def oracle_sql() -> dict[str, str]:
    return dict(_all()[1])
