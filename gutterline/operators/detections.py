"""Filters, overlap joins and ordered folds over detections of a page.

Joins have the page as their key and the geometry as a residual.  The folds
(greedy dedupe, merging, rescue) depend on order: a detection is judged by
those kept before it, so a page's detections are gathered in order and folded.
A page has few detections; ``gathered`` refuses a page that has too many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..plans.profiles import BROWSER, Profile

#: The most detections of a page that a fold takes.
MAX_PER_PAGE = 5000

DETECTION = ["det_id", "cls", "x", "y", "w", "h", "conf"]


def confident(det: DataFrame, profile: Profile = BROWSER) -> DataFrame:
    """Detections above their class's floor."""
    floor = F.when(F.col("cls") == "frame", profile.frame_floor).when(F.col("cls") == "balloon", profile.balloon_floor).otherwise(profile.text_floor)
    return det.where(F.col("conf") >= floor)


def large_enough(det: DataFrame, profile: Profile = BROWSER) -> DataFrame:
    return det.where(Box.of().area / profile.page_area >= profile.min_panel_area)


def liftable(texts: DataFrame, profile: Profile = BROWSER) -> DataFrame:
    """Texts not too large for text; sure ones may be larger."""
    most = F.when(F.col("conf") >= profile.sure_text, profile.sure_text_area).otherwise(profile.text_area)
    return texts.where(Box.of().area / profile.page_area <= most)


def whole_pages(det: DataFrame, profile: Profile = BROWSER) -> DataFrame:
    """Per page the number of sure panels, and whether it has none."""
    sure = (F.col("cls") == "frame") & (F.col("conf") >= profile.sure_panel) & (Box.of().area / profile.page_area >= profile.min_panel_area)
    return det.groupBy("page_id").agg(F.count_if(sure).alias("sure_panels")).withColumn("whole_page", F.col("sure_panels") == 0)


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of a page whose boxes meet: page_id, structs a and b, inter."""
    gather = lambda df, name: df.select("page_id", F.struct(*[c for c in df.columns if c != "page_id"]).alias(name))
    shared = Box.field(F.col("a")).intersection(Box.field(F.col("b")))
    return gather(left, "a").join(gather(right, "b"), "page_id").withColumn("inter", shared).where("inter > 0")


def inside(inner: DataFrame, outer: DataFrame, share: float) -> DataFrame:
    """Pairs (a in b) with at least ``share`` of a inside b."""
    return overlaps(inner, outer).where(F.col("inter") / F.greatest(Box.field(F.col("a")).area, F.lit(1)) >= share)


def folios(boxes: DataFrame, panels: DataFrame, profile: Profile = BROWSER) -> DataFrame:
    """Boxes that are page numbers: one line, in the margin, off every panel."""
    line = (F.col("h") <= 0.04 * profile.page_height) & ((F.col("y") + F.col("h") <= 0.08 * profile.page_height) | (F.col("y") >= 0.92 * profile.page_height))
    candidates = boxes.where(line)
    covered = inside(candidates, panels, 0.2).select("page_id", F.col("a.det_id").alias("det_id")).distinct()
    return candidates.join(covered, ["page_id", "det_id"], "left_anti")


def ranked_by_confidence(det: DataFrame) -> DataFrame:
    """Place among its page's detections, best first, ties in their order."""
    return det.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("conf"), "det_id")))


def gathered(det: DataFrame, *order: Column, name: str = "dets") -> DataFrame:
    """Each page's detections as an array sorted by ``order``."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    packed = F.struct(key.alias("key"), F.struct(*DETECTION).alias("d"))
    rows = det.groupBy("page_id").agg(F.array_sort(F.collect_list(packed)).alias("s"))
    checked = F.when(F.size("s") > MAX_PER_PAGE, F.raise_error(F.lit("a page has more detections than a fold takes"))).otherwise(F.transform("s", lambda e: e.d))
    return rows.select("page_id", checked.alias(name))


def _spread(pages: DataFrame, name: str) -> DataFrame:
    return pages.select("page_id", F.posexplode(name).alias("pos", "d")).select("page_id", F.col("pos").cast("long").alias("pos"), "d.*")


def deduplicated(det: DataFrame, iou: float = BROWSER.dedupe_iou) -> DataFrame:
    """Greedy dedupe: best first, kept if it overlaps none that is kept."""
    pages = gathered(det, -F.col("conf"), F.col("det_id"))
    fits = lambda kept, d: F.forall(kept, lambda k: Box.field(k).iou(Box.field(d)) < iou)
    kept = F.aggregate("dets", F.slice("dets", 1, 0), lambda k, d: F.when(fits(k, d), F.array_append(k, d)).otherwise(k))
    return _spread(pages.withColumn("kept", kept), "kept").drop("pos")


def merged(first: DataFrame, second: DataFrame, iou: float = BROWSER.merge_iou) -> DataFrame:
    """Union of two detectors' texts: each of ``second`` replaces the first
    text that it overlaps if it is surer, and else is dropped; one that
    overlaps none is added."""
    pages = gathered(first, F.col("det_id"), name="a").join(gathered(second, F.col("det_id"), name="b"), "page_id", "full")
    kind = "array<struct<det_id:bigint,cls:string,x:bigint,y:bigint,w:bigint,h:bigint,conf:double>>"
    a, b = (F.coalesce(c, F.array().cast(kind)) for c in ("a", "b"))
    pages = pages.select("page_id", a.alias("a"), b.alias("b"))

    def take(out: Column, d: Column) -> Column:
        hit = F.array_position(F.transform(out, lambda k: Box.field(k).iou(Box.field(d)) >= iou), F.lit(True)).cast("int")
        replaced = F.transform(out, lambda k, i: F.when((i == hit - 1) & (d.conf > k.conf), d).otherwise(k))
        return F.when(hit == 0, F.array_append(out, d)).otherwise(replaced)

    return _spread(pages.withColumn("out", F.aggregate("b", F.col("a"), take)), "out")


def rescued(det: DataFrame, profile: Profile = BROWSER) -> DataFrame:
    """Doubtful frames that cover what no panel, sure or rescued before, does."""
    area = Box.of().area
    sure = gathered(det.where(F.col("conf") >= profile.panel_conf), -F.col("conf"), F.col("det_id"), name="sure")
    doubtful = det.where((F.col("conf") >= profile.rescue_conf) & (F.col("conf") < profile.panel_conf) & (area / profile.page_area >= profile.rescue_area))
    pages = gathered(doubtful, -F.col("conf"), F.col("det_id"), name="doubtful").join(sure, "page_id", "left")
    pages = pages.withColumn("sure", F.coalesce("sure", F.slice("doubtful", 1, 0)))

    def covered(panels: Column, d: Column) -> Column:
        return F.aggregate(panels, F.lit(0).cast("long"), lambda total, p: total + Box.field(p).intersection(Box.field(d))) / Box.field(d).area

    grown = F.aggregate("doubtful", F.col("sure"), lambda panels, d: F.when(covered(panels, d) < profile.rescue_overlap, F.array_append(panels, d)).otherwise(panels))
    return _spread(pages.withColumn("added", F.slice(grown, F.size("sure") + 1, F.size("doubtful"))).where("size(added) > 0"), "added").drop("pos")


def late_balloons(balloons: DataFrame, groups: DataFrame) -> DataFrame:
    """Balloons with no group mostly inside; each one that is added is a group
    for those after it."""
    pages = gathered(balloons, -F.col("conf"), F.col("det_id"), name="balloons").join(gathered(groups, F.col("det_id"), name="groups"), "page_id", "left")
    pages = pages.withColumn("groups", F.coalesce("groups", F.slice("balloons", 1, 0)))
    empty = lambda known, b: F.forall(known, lambda g: Box.field(g).share_inside(Box.field(b)) <= 0.5)
    grown = F.aggregate("balloons", F.col("groups"), lambda known, b: F.when(empty(known, b), F.array_append(known, b)).otherwise(known))
    return _spread(pages.withColumn("added", F.slice(grown, F.size("groups") + 1, F.size("balloons"))).where("size(added) > 0"), "added").drop("pos")


def trimmed(boxes: DataFrame, panels: DataFrame) -> DataFrame:
    """Each box cut back, on the shallower side, from each panel in turn, as
    long as half of it is left."""
    pages = boxes.join(gathered(panels, F.col("det_id"), name="panels"), "page_id", "left")
    make = lambda x, y, w, h: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))
    start = make(*(F.col(c) for c in "xywh"))
    whole = Box.of().area

    def cut(box: Column, panel: Column) -> Column:
        b, p = Box.field(box), Box.field(panel)
        across = F.least(b.right, p.right) - F.greatest(b.x, p.x)
        down = F.least(b.bottom, p.bottom) - F.greatest(b.y, p.y)
        left, right = make(p.right, b.y, b.right - p.right, b.h), make(b.x, b.y, p.x - b.x, b.h)
        top, bottom = make(b.x, p.bottom, b.w, b.bottom - p.bottom), make(b.x, b.y, b.w, p.y - b.y)
        sideways = F.when(p.x + p.w / 2 < b.x + b.w / 2, left).otherwise(right)
        upright = F.when(p.y + p.h / 2 < b.y + b.h / 2, top).otherwise(bottom)
        new = F.when(across < down, sideways).otherwise(upright)
        fine = (across > 0) & (down > 0) & (new.w > 0) & (new.h > 0) & (new.w * new.h >= whole / 2)
        return F.when(fine, new).otherwise(box)

    no_panels = F.coalesce("panels", F.array().cast("array<struct<det_id:bigint,cls:string,x:bigint,y:bigint,w:bigint,h:bigint,conf:double>>"))
    return pages.withColumn("cut", F.aggregate(no_panels, start, cut)).select("page_id", "det_id", *(F.col(f"cut.{c}").alias(c) for c in "xywh"))
