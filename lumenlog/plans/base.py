"""Registration of queries, and the driver's tables as the engine's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.plans.catalog import Query


def registry() -> tuple[dict[str, Query], Callable]:
    """A dict of queries, and a decorator that adds a plan to it with its SQL."""
    found: dict[str, Query] = {}

    def query(sql: str | None = None, name: str | None = None):
        def add(build):
            found[name or build.__name__] = Query(build, sql)
            return build

        return add

    return found, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversation log as events: event_id in order within thread_id."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("event_id"), F.col("conv_id").alias("thread_id"), "turn", "role", "text")


MESSAGES = "(select conv_id * 1000000 + turn as event_id, conv_id as thread_id, turn, role, text from conversations)"
