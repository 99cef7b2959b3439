"""Which balloon a text belongs to, and which panel owns a box."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, contains, samples_in_polygon, samples_inside
from ..plans.profiles import BROWSER, Profile
from .detections import inside, overlaps, ranked_by_confidence


def texts_in_balloons(texts: DataFrame, balloons: DataFrame) -> DataFrame:
    """Each text with the first balloon, by confidence, that holds half of it."""
    pairs = inside(texts, ranked_by_confidence(balloons), 0.5)
    first = F.row_number().over(Window.partitionBy("page_id", "a.det_id").orderBy("b.place"))
    chosen = pairs.withColumn("n", first).where("n = 1")
    return chosen.select("page_id", F.col("a.det_id").alias("text_id"), F.col("b.det_id").alias("balloon_id"))


def groups(texts: DataFrame, balloons: DataFrame) -> DataFrame:
    """One row for each group: a balloon with its texts, or a text of its own."""
    held = texts_in_balloons(texts, balloons)
    with_balloon = held.groupBy("page_id", F.col("balloon_id").alias("det_id")).agg(F.count("*").alias("texts")).join(balloons, ["page_id", "det_id"])
    alone = texts.join(held.select("page_id", F.col("text_id").alias("det_id")), ["page_id", "det_id"], "left_anti").withColumn("texts", F.lit(1).cast("long"))
    return with_balloon.unionByName(alone)


def nearest_panels(boxes: DataFrame, panels: DataFrame) -> DataFrame:
    """The panel nearest to each box's centre, of equal ones the first."""
    pairs = boxes.select("page_id", F.struct("det_id", *"xywh").alias("a")).join(panels.select("page_id", F.struct("det_id", *"xywh").alias("b")), "page_id")
    a, b = Box.field(F.col("a")), Box.field(F.col("b"))
    cx, cy = a.x * 2 + a.w, a.y * 2 + a.h  # twice the centre, in whole numbers
    dx = F.greatest(b.x * 2 - cx, F.lit(0), cx - b.right * 2)
    dy = F.greatest(b.y * 2 - cy, F.lit(0), cy - b.bottom * 2)
    ranked = pairs.withColumn("gap4", dx * dx + dy * dy).withColumn("n", F.row_number().over(Window.partitionBy("page_id", "a.det_id").orderBy("gap4", "b.det_id")))
    return ranked.where("n = 1").select("page_id", F.col("a.det_id").alias("box_id"), F.col("b.det_id").alias("panel_id"), "gap4")


def owners(boxes: DataFrame, panels: DataFrame, profile: Profile = BROWSER, with_box: bool = False) -> DataFrame:
    """The panels that own each box, and by which rule.

    A tail's tip in a single panel that the box touches decides.  Else a panel
    with nearly all of the box owns it alone, the smallest of several.  Else,
    if some panel has half of it, all with a quarter share it, detected panels
    before filled-in ones, unless its focus lies in one of several.  Else the
    panel that overlaps most has it, detected ones first; else the nearest.

    Shares count sample points in the panel's ``polygon``, or in its box where
    panels have no such column; ``tail`` and ``focus`` are columns of boxes,
    structs of x and y that can be null or absent.  One row for each box and
    rule's minimum is kept while panels are looked at, so a box's panels meet
    in one aggregation.  ``with_box`` adds the box's own x, y, w and h.
    """
    point = lambda name: F.col(name).alias(name) if name in boxes.columns else F.lit(None).cast("struct<x: double, y: double>").alias(name)
    shaped = "polygon" in panels.columns
    left = boxes.select("page_id", F.struct("det_id", *"xywh", point("tail"), point("focus")).alias("a"))
    right = panels.select("page_id", F.struct("det_id", "conf", *"xywh", *(["polygon"] if shaped else [])).alias("b"))
    pairs, a, b = left.join(right, "page_id"), Box.field(F.col("a")), Box.field(F.col("b"))
    outline = F.col("b.polygon") if shaped else b.polygon()
    # a point that no box has is not looked for in each pair's outline
    holds = lambda name: F.coalesce(contains(outline, F.col(f"a.{name}.x").cast("double"), F.col(f"a.{name}.y").cast("double")) & F.col(f"a.{name}").isNotNull(), F.lit(False)) if name in boxes.columns else F.lit(False)
    dx = F.greatest(b.x * 2 - (a.x * 2 + a.w), F.lit(0), a.x * 2 + a.w - b.right * 2)
    dy = F.greatest(b.y * 2 - (a.y * 2 + a.h), F.lit(0), a.y * 2 + a.h - b.bottom * 2)
    own = list("xywh") if with_box else []
    facts = pairs.select(
        "page_id", F.col("a.det_id").alias("box_id"), F.col("b.det_id").alias("panel_id"), a.intersection(b).alias("inter"), b.area.alias("area"), (dx * dx + dy * dy).alias("gap"),
        (samples_in_polygon(outline, a) if shaped else samples_inside(b, a)).alias("hits"), (F.col("b.conf") >= profile.rescue_conf).alias("seen"), holds("tail").alias("tailed"), holds("focus").alias("focused"), *(F.col(f"a.{c}") for c in own),
    )
    whole, clear, shared = (F.col("hits") >= share * 36 for share in (profile.whole_share, profile.clear_share, profile.shared_share))
    pointed, touched = F.col("tailed") & (F.col("inter") > 0), F.col("inter") > 0
    best = lambda when, value: F.min(F.when(when, F.struct(value.alias("value"), "panel_id")))["panel_id"]
    found = facts.groupBy("page_id", "box_id").agg(
        F.count_if(pointed).alias("tails"), best(pointed, F.lit(0)).alias("tail"), best(whole, F.col("area")).alias("whole"), F.coalesce(F.bool_or(clear), F.lit(False)).alias("clear"),
        F.collect_list(F.when(shared, F.struct("panel_id", "seen", "focused"))).alias("sharing"), best(touched & F.col("seen"), -F.col("inter")).alias("seen_box"), best(touched, -F.col("inter")).alias("box"), best(F.lit(True), F.col("gap")).alias("nearest"), *(F.first(c).alias(c) for c in own),
    )
    found = found.withColumn("seen_sharing", F.filter("sharing", lambda p: p.seen)).withColumn("sharing", F.when(F.size("seen_sharing") > 0, F.col("seen_sharing")).otherwise(F.col("sharing")))
    found = found.withColumn("in_focus", F.filter("sharing", lambda p: p.focused))
    one, ids = (lambda c: F.array(F.col(c))), (lambda c: F.transform(c, lambda p: p.panel_id))
    rules = (
        ("tail", F.col("tails") == 1, one("tail")), ("whole", F.col("whole").isNotNull(), one("whole")), ("focus", F.col("clear") & (F.size("sharing") > 1) & (F.size("in_focus") == 1), ids("in_focus")),
        ("shared", F.col("clear"), ids("sharing")), ("box", F.col("seen_box").isNotNull(), one("seen_box")), ("box", F.col("box").isNotNull(), one("box")), ("nearest", F.lit(True), one("nearest")),
    )
    chosen = F.coalesce(*(F.when(when, F.struct(F.lit(name).alias("rule"), panels.alias("panels"))) for name, when, panels in rules))
    return found.select("page_id", "box_id", chosen.alias("chosen"), *own).select("page_id", "box_id", F.explode("chosen.panels").alias("panel_id"), "chosen.rule", *own)


def framed(panels: DataFrame, owned: DataFrame) -> DataFrame:
    """Each panel's box grown to hold the boxes it owns."""
    # the page alone is the join's key: rows that lie by page stay where they are
    grown = owned.groupBy("page_id", "panel_id").agg(F.min("x").alias("bx"), F.min("y").alias("by"), F.max(F.col("x") + F.col("w")).alias("bx2"), F.max(F.col("y") + F.col("h")).alias("by2"))
    grown = grown.withColumnRenamed("page_id", "grown_page").withColumnRenamed("panel_id", "grown_panel")
    same = (F.col("page_id") == F.col("grown_page")) & (F.col("panel_id") >= F.col("grown_panel")) & (F.col("panel_id") <= F.col("grown_panel"))
    rows = panels.withColumnRenamed("det_id", "panel_id").join(grown, same, "left")
    x, y = F.least("x", F.coalesce("bx", "x")), F.least("y", F.coalesce("by", "y"))
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    return rows.select("page_id", "panel_id", x.alias("x"), y.alias("y"), (F.greatest(right, F.coalesce("bx2", right)) - x).alias("w"), (F.greatest(bottom, F.coalesce("by2", bottom)) - y).alias("h"))


__all__ = ["framed", "groups", "nearest_panels", "overlaps", "owners", "texts_in_balloons"]
