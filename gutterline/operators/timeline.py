"""Beats of a panel, durations, session series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.profiles import BROWSER, Profile


def read_ms(ink: Column, profile: Profile = BROWSER) -> Column:
    """How long a balloon is read, by its share of ink: clamped, rounded half up."""
    wanted = F.lit(float(profile.read_min_ms)) + ink * float(profile.read_per_ink)
    return F.floor(F.least(F.greatest(wanted, F.lit(float(profile.read_min_ms))), F.lit(float(profile.read_max_ms))) + 0.5).cast("long")


def beats(balloons: DataFrame, profile: Profile = BROWSER) -> DataFrame:
    """(panel, ord, ink) to (panel, seq, t, ms, hold, kind): the entrance, a
    reveal for each balloon once those before it have been read, and a rest."""
    panel = Window.partitionBy("panel").orderBy("ord")
    spent = F.coalesce(F.sum(F.lit(profile.reveal_ms) + F.col("read")).over(panel.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    timed = balloons.withColumn("read", read_ms(F.col("ink"), profile)).select("panel", F.row_number().over(panel).cast("long").alias("seq"), (spent + profile.enter_ms).alias("t"), F.lit(profile.reveal_ms).cast("long").alias("ms"), "read")
    long = lambda n: F.lit(n).cast("long")
    reveal = timed.select("panel", "seq", "t", "ms", long(0).alias("hold"), F.lit("reveal").alias("kind"))
    enter = timed.groupBy("panel").agg(long(0).alias("seq"), long(0).alias("t"), long(profile.enter_ms).alias("ms"), long(0).alias("hold"), F.lit("enter").alias("kind"))
    rest = timed.groupBy("panel").agg((F.max("seq") + 1).alias("seq"), F.max(F.col("t") + F.col("ms") + F.col("read")).alias("t"), long(0).alias("ms"), long(profile.tail_ms).alias("hold"), F.lit("rest").alias("kind"))
    return enter.unionByName(reveal).unionByName(rest)


def durations(frames: DataFrame, fallback_ms: int) -> DataFrame:
    """(panel, t, ms, hold) rows to the end of each panel's last beat; a panel
    whose beats are null gets the fallback, none ends before 0."""
    end = F.max(F.col("t") + F.col("ms") + F.coalesce("hold", F.lit(0)))
    return frames.groupBy("panel").agg(F.when(end.isNull(), F.lit(fallback_ms)).otherwise(F.greatest(end, F.lit(0))).cast("long").alias("duration_ms"))


def eta(progress: DataFrame, lookback: int = 5) -> DataFrame:
    """(key, i, t, total): microseconds left, at the pace of the last steps."""
    series = Window.partitionBy("key").orderBy("i")
    from_t = F.coalesce(F.lag("t", lookback).over(series), F.first("t").over(series))
    steps = F.least(F.col("i"), F.lit(lookback))
    return progress.select("key", "i", F.when(steps > 0, F.floor((F.col("t") - from_t) * (F.col("total") - F.col("i") - 1) / steps)).cast("long").alias("left_us"))


def directions(moves: DataFrame) -> DataFrame:
    """(key, i, place): the way of each step, kept while standing still."""
    series = Window.partitionBy("key").orderBy("i")
    step = F.signum(F.col("place") - F.lag("place").over(series)).cast("int")
    way = F.last(F.nullif("step", F.lit(0)), ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, 0))
    return moves.withColumn("step", step).select("key", "i", F.coalesce(way, F.lit(1)).alias("direction"))


def spans(marks: DataFrame) -> DataFrame:
    """(key, t, tag): time from each mark to the next one."""
    return marks.select("key", "t", "tag", (F.lead("t").over(Window.partitionBy("key").orderBy("t")) - F.col("t")).alias("span"))


def janks(frames: DataFrame, least: int, most: int) -> DataFrame:
    """(key, t): gaps to the frame before of at least ``least`` and under ``most``."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("key").orderBy("t"))
    return frames.withColumn("gap", gap).where((F.col("gap") >= least) & (F.col("gap") < most))


def looked_back(points: DataFrame, marks: DataFrame, reach: int) -> DataFrame:
    """Marks in [t - gap - reach, t] of each point (key, t, gap).

    A range join with a time bucket as its key: a point asks every bucket
    that its reach touches, so the work follows the matches.
    """
    bucket = lambda c: F.floor(c / reach).cast("long")
    asked = points.withColumn("bucket", F.explode(F.sequence(bucket(F.col("t") - F.col("gap") - reach), bucket(F.col("t")))))
    held = marks.select("key", F.col("t").alias("mark_t"), "tag", bucket(F.col("t")).alias("bucket"))
    return asked.join(held, ["key", "bucket"]).where((F.col("mark_t") <= F.col("t")) & (F.col("mark_t") >= F.col("t") - F.col("gap") - reach)).drop("bucket")


def upper_median(values: DataFrame, key: str, value: str) -> DataFrame:
    """The order statistic at place n / 2, counted from 0."""
    ordered = Window.partitionBy(key).orderBy(value)
    ranked = values.select(key, value, (F.row_number().over(ordered) - 1).alias("place"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    return ranked.where(F.col("place") == F.floor(F.col("n") / 2)).select(key, F.col(value).alias("median"), "n")


def pan_progress(ticks: DataFrame, stops: list[int], ms: int, delay: int, end: int = 1_000_000) -> DataFrame:
    """How far a pan is after each tick: (key, t, event_id, dt, revealed) with
    ``place``, in parts of ``end``.

    Each tick moves it on by its share of ``ms``, but never beyond the first
    stop that isn't revealed yet; it starts when ``delay`` has passed.  A walk
    under changing limits is the free walk, less the most that any limit so
    far has cut off it: two running windows instead of a fold.
    """
    order = Window.partitionBy("key").orderBy("t", "event_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    waited = F.coalesce(F.sum("dt").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limit = F.coalesce(F.get(F.lit(stops), F.col("revealed").cast("int")).cast("long"), F.lit(end).cast("long"))
    walk = ticks.withColumn("step", F.when(waited >= delay, F.floor(F.col("dt") * end / ms)).otherwise(0)).withColumn("limit", limit)
    walk = walk.withColumn("free", F.sum("step").over(so_far)).withColumn("room", F.col("limit") - F.col("free"))
    return walk.withColumn("place", F.col("free") + F.least(F.lit(0), F.min("room").over(so_far))).drop("step", "limit", "free", "room")
