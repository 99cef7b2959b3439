"""Keyed stores as queries over a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, at: str, *ties: str, deleted: Column | None = None) -> DataFrame:
    """The last change of each key, without keys whose last one deletes."""
    order = Window.partitionBy(key).orderBy(F.desc(at), *(F.desc(t) for t in ties))
    last = log.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return last if deleted is None else last.where(~deleted)


def toggled(log: DataFrame, *key: str) -> DataFrame:
    """Keys that were toggled an odd number of times."""
    return log.groupBy(*key).agg(F.count("*").alias("toggles")).where("toggles % 2 = 1")


def newest(rows: DataFrame, n: int, at: str, *ties: str, by: str | None = None) -> DataFrame:
    """The n newest rows, in all or of each ``by``; only n rows of a task are
    sent on."""
    order = [F.desc(at), *(F.desc(t) for t in ties)]
    if by is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def prefix(pages: DataFrame, key: str, place: str) -> DataFrame:
    """Rows of each key at places 0, 1, 2, ... up to the first gap."""
    order = Window.partitionBy(key).orderBy(place)
    return pages.withColumn("__n", F.row_number().over(order) - 1).where(F.col("__n") == F.col(place)).drop("__n")


def running_max(progress: DataFrame, key: str, at: str, value: str, most: float = 1.0) -> DataFrame:
    """Progress that never falls back, and never exceeds ``most``."""
    so_far = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return progress.withColumn(value, F.least(F.max(value).over(so_far), F.lit(most)))


def first_run(frames: DataFrame, key: str, place: str, page: str) -> DataFrame:
    """The first contiguous run of each page in its key's order."""
    order = Window.partitionBy(key).orderBy(place)
    started = F.when(F.col(page).eqNullSafe(F.lag(page).over(order)), 0).otherwise(1)
    runs = frames.withColumn("__s", started).withColumn("__r", F.sum("__s").over(order))
    lowest = F.min("__r").over(Window.partitionBy(key, page))
    return runs.withColumn("__l", lowest).where("__r = __l").drop("__s", "__r", "__l")


def ahead(frames: DataFrame, key: str, place: str, value: str, n: int = 8) -> DataFrame:
    """The distinct values of the next n rows."""
    next_rows = Window.partitionBy(key).orderBy(place).rowsBetween(1, n)
    return frames.withColumn("ahead", F.array_sort(F.array_distinct(F.collect_list(value).over(next_rows))))
