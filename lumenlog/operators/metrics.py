"""Usage metrics: request ledger, rollups, activity, timelines, histograms, percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Inclusive upper edges of the session size buckets; the last bucket is open.
SIZE_EDGES = (1_000, 5_000, 10_000, 50_000, 100_000, 500_000, 1_000_000)


def request_ledger(requests: DataFrame, measures: list[str], cost: str = "cost", keys: tuple[str, ...] = ("thread_id", "request_key")) -> DataFrame:
    """One row per request: the greatest of each measure (0 if none), the least month, the greatest cost (null if none).

    MAX and MIN merge in any order, so repeated and late rows never change what is already counted.
    """
    return requests.groupBy(*keys).agg(F.min("month").alias("month"), *[F.coalesce(F.max(m), F.lit(0)).alias(m) for m in measures], F.max(cost).alias(cost))


def merged_ledger(stored: DataFrame, batch: DataFrame, measures: list[str], cost: str = "cost", keys: tuple[str, ...] = ("thread_id", "request_key")) -> DataFrame:
    """The ledger after a batch: the same aggregate over what is stored and what is new."""
    return request_ledger(stored.unionByName(batch), measures, cost, keys)


def activity(events: DataFrame, thread: str, at: str) -> DataFrame:
    return events.groupBy(thread).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def dense(axis: DataFrame, rows: DataFrame, on: list[str], fill: dict) -> DataFrame:
    """Every point of an axis, with zeros where no row is."""
    return axis.join(rows, on, "left").fillna(fill)


def day_axis(rows: DataFrame, at: str) -> DataFrame:
    """(day) from the first to the last day of `at`."""
    span = rows.agg(F.min(F.to_date(at)).alias("a"), F.max(F.to_date(at)).alias("z"))
    return span.filter("a is not null").select(F.explode(F.sequence("a", "z", F.expr("interval 1 day"))).alias("day"))


def folded_top(rows: DataFrame, name: str, value: str, k: int, other: str = "other") -> DataFrame:
    """Sums by name, all but the k largest folded into one: k names are all that is broadcast."""
    sums = rows.groupBy(name).agg(F.sum(value).alias(value))
    top = sums.orderBy(F.desc(value), name).limit(k).select(F.col(name).alias("__top"))
    kept = sums.join(F.broadcast(top), F.col(name) == F.col("__top"), "left").withColumn(name, F.coalesce("__top", F.lit(other)))
    return kept.groupBy(name).agg(F.sum(value).alias(value))


def size_bucket(size: Column, edges=SIZE_EDGES) -> Column:
    out = F.lit(len(edges))
    for i, edge in reversed(list(enumerate(edges))):
        out = F.when(size <= edge, i).otherwise(out)
    return out


def nearest_rank(value: str, q: float) -> Column:
    """The ceil(q n)-th of n values."""
    return F.expr(f"percentile_disc({q}) within group (order by {value})")


def floor_rank(rows: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """The value at 0-based place min(int(q n), n - 1) of each group."""
    own = Window.partitionBy(*by)
    placed = rows.withColumn("__r", F.row_number().over(own.orderBy(value))).withColumn("__n", F.count(F.lit(1)).over(own))
    return placed.filter(F.col("__r") == F.least(F.floor(F.col("__n") * q).cast("int") + 1, F.col("__n"))).select(*by, F.col(value).alias(name))


#: What varies within one kind of fault, and the mark that stands for it.
VARYING = (
    (r"\b[0-9A-HJKMNP-TV-Z]{26}\b", "<id>"), (r"\b[0-9a-fA-F]{2,}(?:-[0-9a-fA-F]{2,})+\b", "<id>"), (r"\b(?=[0-9a-f]*[0-9])[0-9a-f]{6,}\b", "<id>"), (r"(?<![\w/])/[^\s:]+", "<path>"), (r"[0-9]+", "N"),
)


def fault_signature(message: Column, most: int = 300) -> Column:
    """A message with its ids, paths and numbers folded, cut to `most` characters."""
    return F.substring(reduce(lambda text, fold: F.regexp_replace(text, *fold), VARYING, message), 1, most)
