"""Transcript reconstruction: turns, steps, neighbours, views and budgets, all as windows within a thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _so_far(thread: str, order: str):
    return Window.partitionBy(thread).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def with_turns(events: DataFrame, thread: str = "thread_id", order: str = "event_id", role: str = "role") -> DataFrame:
    """turn_no: a user event opens a turn, what follows joins it; 0 before the first."""
    return events.withColumn("turn_no", F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(_so_far(thread, order)))


def with_steps(events: DataFrame, closes: Column, thread: str = "thread_id", order: str = "event_id", role: str = "role") -> DataFrame:
    """step_no: a step ends after an event that closes it, or where the role changes."""
    w = Window.partitionBy(thread).orderBy(order)
    marked = events.withColumn("__closed", F.lag(closes, 1, False).over(w)).withColumn("__changed", ~F.col(role).eqNullSafe(F.lag(role).over(w)))
    return marked.withColumn("step_no", F.sum((F.col("__closed") | F.col("__changed")).cast("int")).over(_so_far(thread, order))).drop("__closed", "__changed")


def forward_filled(events: DataFrame, column: str, thread: str = "thread_id", order: str = "event_id") -> DataFrame:
    """A null value takes the one before it in its thread."""
    return events.withColumn(column, F.last(column, ignorenulls=True).over(_so_far(thread, order)))


def neighbours(events: DataFrame, hits: DataFrame, n: int, thread: str = "thread_id", order: str = "event_id") -> DataFrame:
    """(hit, distance, event) of the n events before and after each hit, by position within the thread."""
    placed = events.withColumn("__at", F.row_number().over(Window.partitionBy(thread).orderBy(order)))
    at = placed.join(hits.select(F.col(order).alias("__hit")), F.col(order) == F.col("__hit"), "left_semi").select(F.col(thread).alias("__thread"), F.col(order).alias("hit_id"), F.col("__at").alias("__hit_at"))
    near = at.withColumn("distance", F.explode(F.sequence(F.lit(-n), F.lit(n))))
    return placed.join(near, (F.col(thread) == F.col("__thread")) & (F.col("__at") == F.col("__hit_at") + F.col("distance"))).drop("__thread", "__at", "__hit_at")


def budgeted(events: DataFrame, size: Column, budget: int, thread: str = "thread_id", order: str = "event_id") -> DataFrame:
    """The leading events of each thread whose sizes add up to `budget`; the first always, even if it is larger."""
    total = F.sum(size).over(_so_far(thread, order))
    first = F.row_number().over(Window.partitionBy(thread).orderBy(order)) == 1
    return events.withColumn("__total", total).withColumn("__first", first).filter((F.col("__total") <= budget) | F.col("__first")).drop("__total", "__first")


def ends(events: DataFrame, n: int, thread: str = "thread_id", order: str = "event_id") -> DataFrame:
    """The first n and the last n events of each thread, none twice."""
    own = Window.partitionBy(thread)
    placed = events.withColumn("__at", F.row_number().over(own.orderBy(order))).withColumn("__n", F.count(F.lit(1)).over(own))
    return placed.filter((F.col("__at") <= n) | (F.col("__at") > F.col("__n") - n)).drop("__at", "__n")
