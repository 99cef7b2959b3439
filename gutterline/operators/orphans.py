"""Ink that no panel covers, as candidate panels.

The uncovered ink of a page's grid is opened, so that lines between panels
go, and falls into zones.  Zones that are large, broad and solid enough are
trimmed against the panels and kept if little of what is left was covered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import raster
from .detections import gathered, trimmed

#: Of the page: least area and sides of a zone; least fill of its box; most that panels may cover.
LEAST_AREA, LEAST_SIDE, LEAST_FILL, MOST_COVERED = 0.06, 0.12, 0.6, 0.2


def solid(zones: DataFrame, side: int = raster.SIDE) -> DataFrame:
    """Zones that are large, broad and full enough to be panels."""
    large = F.col("area") / (side * side) >= LEAST_AREA
    broad = (F.col("w") / side >= LEAST_SIDE) & (F.col("h") / side >= LEAST_SIDE)
    return zones.where(large & broad & (F.col("area") / (F.col("w") * F.col("h")) >= LEAST_FILL))


def covered_cells(panels: Column, side: int = raster.SIDE) -> Column:
    """1 for each cell whose centre is in a panel."""

    def cell(i: Column) -> Column:
        x, y = i % side + 0.5, F.floor(i / side) + 0.5
        return F.exists(panels, lambda p: (x >= p.x) & (x < p.x + p.w) & (y >= p.y) & (y < p.y + p.h)).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), cell)


def orphans(masks: DataFrame, panels: DataFrame, side: int = raster.SIDE) -> DataFrame:
    """(page_id, mask) and panels in cells to page_id, label, area, x, y, w, h:
    the zones that are left, trimmed."""
    pages = masks.join(gathered(panels, F.col("det_id"), name="panels"), "page_id", "left")
    pages = pages.withColumn("covered", F.coalesce(covered_cells(F.col("panels"), side), F.array_repeat(F.lit(0), side * side))).drop("panels")
    bare = F.zip_with("mask", "covered", lambda m, c: F.when(c == 1, 0).otherwise(m))
    shrunk = pages.withColumn("bare", bare).select(F.col("page_id").alias("vec_id"), raster.eroded(F.col("bare"), side).alias("mask"))
    zones = solid(raster.components(shrunk.select("vec_id", raster.dilated(F.col("mask"), side).alias("mask")), diagonal=False, side=side), side)
    boxes = trimmed(zones.select(F.col("vec_id").alias("page_id"), F.col("label").alias("det_id"), "x", "y", "w", "h"), panels)
    left = boxes.join(pages.select("page_id", "covered"), "page_id")
    x0, y0 = F.greatest(F.floor("x"), F.lit(0)), F.greatest(F.floor("y"), F.lit(0))
    x1, y1 = F.least(F.ceil(F.col("x") + F.col("w")), F.lit(side)), F.least(F.ceil(F.col("y") + F.col("h")), F.lit(side))
    within = lambda v, i: (v == 1) & (i % side >= x0) & (i % side < x1) & (F.floor(i / side) >= y0) & (F.floor(i / side) < y1)
    share = F.size(F.filter("covered", within)) / F.greatest((x1 - x0) * (y1 - y0), F.lit(1))
    kept = left.where(share < MOST_COVERED).select("page_id", F.col("det_id").alias("label"), "x", "y", "w", "h")
    return kept.join(zones.select(F.col("vec_id").alias("page_id"), "label", "area"), ["page_id", "label"])
