"""Engine inputs, derived inside Spark from the tables: detections, dialogue,
marks, rasters.  ``DETECTIONS_SQL`` derives the same detections in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def detections(spark: SparkSession, sf_dir: str, *classes: str) -> DataFrame:
    """page_id, det_id, cls, x, y, w, h, conf: one row for each line item, a
    page for each order; only ``classes`` if any are named."""
    number = F.row_number().over(Window.partitionBy("page_id").orderBy(*_KEY)).cast("long")
    kind = F.when(F.col("l_returnflag") == "N", "frame").when(F.col("l_returnflag") == "A", "balloon").otherwise("text")
    # the page has its name before the window, so that what follows by page needs no shuffle of its own
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), *_KEY)
    rows = items.select(
        "page_id", number.alias("det_id"), kind.alias("cls"),
        (F.col("l_partkey") * 37 % 600).alias("x"), ((F.col("l_suppkey") * 53 + F.col("l_linenumber") * 211) % 1000).alias("y"),
        (F.col("l_partkey") % 250 + 150).alias("w"), (F.col("l_quantity").cast("int") * 7 + 120).cast("long").alias("h"),
        ((F.col("l_partkey") % 1000) / 1000.0).alias("conf"),
    )
    return rows.where(F.col("cls").isin(*classes)) if classes else rows


def dealt(rows: DataFrame, by: Column | None = None) -> DataFrame:
    """Pages dealt on to all of the session's shuffle partitions: their rows
    are few bytes, so they would be merged into few tasks, but their pictures
    are much work.  Rows that are the same work meet ``by`` a hash of it."""
    # by a hash of its own: by the page itself, as they lie, it would be left out
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("page_id") if by is None else by)


DETECTIONS_SQL = f"""det as (select l_orderkey as page_id, row_number() over (partition by l_orderkey order by {", ".join(_KEY)}) as det_id,
 case l_returnflag when 'N' then 'frame' when 'A' then 'balloon' else 'text' end as cls,
 (l_partkey * 37) % 600 as x, (l_suppkey * 53 + l_linenumber * 211) % 1000 as y, 150 + l_partkey % 250 as w,
 cast(120 + cast(l_quantity as int) * 7 as bigint) as h, (l_partkey % 1000) / cast(1000 as double) as conf from lineitem)"""


def overlap_sql(a: str, b: str) -> str:
    """SQL for the common area of two boxes."""
    return f"(greatest(least({a}.x+{a}.w,{b}.x+{b}.w)-greatest({a}.x,{b}.x),0)*greatest(least({a}.y+{a}.h,{b}.y+{b}.h)-greatest({a}.y,{b}.y),0))"


def micro(value: Column) -> Column:
    """A double as whole millionths, rounded half up: the same in any engine."""
    return F.floor(value * 1e6 + 0.5).cast("long")


def micro_sql(value: str) -> str:
    return f"cast(floor(({value}) * cast(1e6 as double) + cast(0.5 as double)) as bigint)"
