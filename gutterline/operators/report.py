"""The report of a detection run: a JSON line for each page, totals, and the
cards of a gallery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLASSES = ("frame", "balloon", "text")
SCHEMA = "page string, ms double, counts struct<frame:bigint,balloon:bigint,text:bigint>, dets array<struct<cls:string,conf:double,bbox:array<double>>>"


def pages(det: DataFrame, timings: DataFrame) -> DataFrame:
    """Detections and (page_id, ms) to page, ms, counts by class, detections in order."""
    one = F.struct("det_id", "cls", F.col("conf").cast("double").alias("conf"), F.array(*(F.col(c).cast("double") for c in "xywh")).alias("bbox"))
    counts = F.struct(*(F.count_if(F.col("cls") == c).alias(c) for c in CLASSES)).alias("counts")
    rows = det.groupBy("page_id").agg(counts, F.transform(F.array_sort(F.collect_list(one)), lambda d: F.struct(d.cls, d.conf, d.bbox)).alias("dets"))
    return rows.join(timings, "page_id").select(F.col("page_id").cast("string").alias("page"), F.round("ms", 1).alias("ms"), "counts", "dets")


def written(report: DataFrame, path: str) -> DataFrame:
    """The report as JSON lines in a folder, read back."""
    report.write.json(path)
    return read(report.sparkSession, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def totals(report: DataFrame) -> DataFrame:
    """One row: pages, detections by class, mean and upper median time, and
    the minutes that a volume of 200 pages would take."""
    per_time = report.groupBy("ms").agg(F.count("*").alias("n"), *(F.sum(f"counts.{c}").alias(c) for c in CLASSES))  # few: times are rounded
    ranked = per_time.withColumn("upto", F.sum("n").over(Window.orderBy("ms"))).withColumn("half", F.floor(F.sum("n").over(Window.partitionBy()) / 2))
    mean = F.sum(F.col("ms") * F.col("n")) / F.sum("n")
    return ranked.agg(
        F.sum("n").alias("pages"), *(F.sum(c).alias(c) for c in CLASSES), mean.alias("mean_ms"), F.min(F.when(F.col("upto") > F.col("half"), F.col("ms"))).alias("median_ms"), (mean * 200 / 60_000).alias("volume_minutes")
    )


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def cards(report: DataFrame) -> DataFrame:
    """(page, card): an HTML figure with a page's counts and time."""
    shown = F.format_string("<figure><figcaption><span>%s</span> %d frames, %d balloons, %d texts, %d ms</figcaption></figure>", _escaped(F.col("page")), *(F.col(f"counts.{c}") for c in CLASSES), F.floor(F.col("ms") + 0.5).cast("long"))
    return report.select("page", shown.alias("card"))
