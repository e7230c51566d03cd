"""Every query of the engine by name: the Spark plan and, where SQL expresses it, the SQL it is held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


MODULES: tuple[str, ...] = ("retrieval", "reading", "statistics", "ingestion", "building", "analysis", "integrity", "reports")


def catalog() -> dict[str, Query]:
    """name -> Query over all query modules; a name may occur once."""
    found: dict[str, Query] = {}
    for module in MODULES:
        for name, query in importlib.import_module(f"lumenlog.plans.{module}").QUERIES.items():
            if name in found:
                raise ValueError(f"two queries are named {name}")
            found[name] = query
    return found
