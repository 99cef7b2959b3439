"""Queries over detections: filters, joins, folds, assignment, camera."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import assign, detections as ops, order
from .inputs import DETECTIONS_SQL, detections, micro, micro_sql, overlap_sql
from .profiles import BROWSER
from .registry import query

WITH = f"with {DETECTIONS_SQL}"
RECURSIVE = f"with recursive {DETECTIONS_SQL}"
AREA = float(BROWSER.page_area)
PAGE = "cast(1500000 as double)"
CLASSES = {c: f"{c}s as (select * from det where cls = '{c}')" for c in ("frame", "balloon", "text")}


def _one(spark: SparkSession, sf: str, cls: str) -> DataFrame:
    return detections(spark, sf, cls)


@query("f3_confidence_filter", f"{WITH} select page_id, det_id, cls, conf from det where conf >= case cls when 'frame' then cast(0.02 as double) when 'balloon' then cast(0.25 as double) else cast(0.05 as double) end")
def confidence_filter(spark, sf):
    return ops.confident(detections(spark, sf)).select("page_id", "det_id", "cls", "conf")


@query("f4_min_area", f"{WITH} select page_id, det_id, w * h as area from det where cls = 'frame' and w * h / {PAGE} >= cast(0.02 as double)")
def min_area(spark, sf):
    return ops.large_enough(_one(spark, sf, "frame")).select("page_id", "det_id", (F.col("w") * F.col("h")).alias("area"))


@query("f5_max_text_area", f"{WITH} select page_id, det_id, w * h as area, conf from det where cls = 'text' and w * h / {PAGE} <= case when conf >= cast(0.7 as double) then cast(0.12 as double) else cast(0.04 as double) end")
def max_text_area(spark, sf):
    return ops.liftable(_one(spark, sf, "text")).select("page_id", "det_id", (F.col("w") * F.col("h")).alias("area"), "conf")


_WHOLE = f"wp as (select page_id, count(*) filter (cls = 'frame' and conf >= cast(0.5 as double) and w * h / {PAGE} >= cast(0.02 as double)) as sure_panels from det group by page_id)"


@query("f6_whole_page", f"{WITH}, {_WHOLE} select page_id, sure_panels, sure_panels = 0 as whole_page from wp")
def whole_page(spark, sf):
    return ops.whole_pages(detections(spark, sf))


@query(
    "f7_whole_page_texts",
    f"""{WITH}, {_WHOLE} select t.page_id, t.det_id from det t join wp on wp.page_id = t.page_id and wp.sure_panels = 0 where t.cls = 'text'
 and (t.conf >= cast(0.6 as double) or exists (select 1 from det b where b.page_id = t.page_id and b.cls = 'balloon' and b.conf >= cast(0.6 as double)
 and {overlap_sql("t", "b")} / cast(t.w * t.h as double) >= cast(0.5 as double)))""",
)
def whole_page_texts(spark, sf):
    det = detections(spark, sf)
    pages = ops.whole_pages(det).where("whole_page").select("page_id")
    here = det.join(pages, "page_id")
    texts, balloons = here.where("cls = 'text'"), here.where(f"cls = 'balloon' and conf >= {BROWSER.boxed_text}D")
    held = ops.inside(texts, balloons, 0.5).select("page_id", F.col("a.det_id").alias("det_id"))
    return texts.where(F.col("conf") >= BROWSER.boxed_text).select("page_id", "det_id").union(held).distinct()


_LINES = "lines as (select page_id, det_id, x, (y * 7) % 1490 as y, w, 10 + h % 70 as h from det where cls = 'text')"


def _lines(spark, sf):
    return _one(spark, sf, "text").withColumn("y", F.col("y") * 7 % 1490).withColumn("h", F.col("h") % 70 + 10)


@query(
    "f8_is_folio",
    f"""{WITH}, {_LINES} select page_id, det_id, y, h from lines t where h <= cast(60 as double) and (y + h <= cast(0.08 as double) * 1500 or y >= cast(0.92 as double) * 1500)
 and not exists (select 1 from det p where p.cls = 'frame' and p.page_id = t.page_id and {overlap_sql("t", "p")} / cast(greatest(t.w * t.h, 1) as double) >= cast(0.2 as double))""",
)
def is_folio(spark, sf):
    return ops.folios(_lines(spark, sf), _one(spark, sf, "frame")).select("page_id", "det_id", "y", "h")


@query("f9_tiny_box", f"{WITH} select page_id, det_id, w % 5 as w, h % 5 as h from det where w % 5 >= 2 and h % 5 >= 2")
def tiny_box(spark, sf):
    return detections(spark, sf).select("page_id", "det_id", (F.col("w") % 5).alias("w"), (F.col("h") % 5).alias("h")).where("w >= 2 and h >= 2")


@query(
    "j1_overlap_pairs",
    f"""{WITH} select a.page_id, a.det_id as a_id, b.det_id as b_id, {overlap_sql("a", "b")} as inter, a.w * a.h + b.w * b.h - {overlap_sql("a", "b")} as total
 from det a join det b on a.page_id = b.page_id and a.det_id < b.det_id where {overlap_sql("a", "b")} > 0""",
)
def overlap_pairs(spark, sf):
    det = detections(spark, sf)
    pairs = ops.overlaps(det, det).where("a.det_id < b.det_id")
    return pairs.select("page_id", F.col("a.det_id").alias("a_id"), F.col("b.det_id").alias("b_id"), "inter", (F.expr("a.w * a.h + b.w * b.h") - F.col("inter")).alias("total"))


_HELD = f"""ranked as (select *, row_number() over (partition by page_id order by conf desc, det_id) as place from det where cls = 'balloon'),
held as (select t.page_id, t.det_id as text_id, b.det_id as balloon_id, row_number() over (partition by t.page_id, t.det_id order by b.place) as n
 from det t join ranked b on b.page_id = t.page_id where t.cls = 'text' and {overlap_sql("t", "b")} / cast(greatest(t.w * t.h, 1) as double) >= cast(0.5 as double))"""


@query("j4_group_texts", f"{WITH}, {_HELD} select page_id, text_id, balloon_id from held where n = 1")
def group_texts(spark, sf):
    return assign.texts_in_balloons(_one(spark, sf, "text"), _one(spark, sf, "balloon"))


@query("j5_unmatched_texts", f"{WITH}, {_HELD} select page_id, det_id from det t where cls = 'text' and not exists (select 1 from held where held.page_id = t.page_id and held.text_id = t.det_id)")
def unmatched_texts(spark, sf):
    texts = _one(spark, sf, "text")
    held = assign.texts_in_balloons(texts, _one(spark, sf, "balloon")).select("page_id", F.col("text_id").alias("det_id"))
    return texts.select("page_id", "det_id").join(held, ["page_id", "det_id"], "left_anti")


@query("j7_balloons_without_text", f"{WITH} select page_id, det_id from det b where cls = 'balloon' and not exists (select 1 from det t where t.cls = 'text' and t.page_id = b.page_id and {overlap_sql('t', 'b')} / cast(greatest(t.w * t.h, 1) as double) >= cast(0.5 as double))")
def balloons_without_text(spark, sf):
    balloons = _one(spark, sf, "balloon")
    held = ops.inside(_one(spark, sf, "text"), balloons, 0.5).select("page_id", F.col("b.det_id").alias("det_id")).distinct()
    return balloons.select("page_id", "det_id").join(held, ["page_id", "det_id"], "left_anti")


_HITS = "(" + " + ".join(f"(case when {{a}}.x + {{a}}.w * cast({k} as double) / 5 >= {{b}}.x and {{a}}.x + {{a}}.w * cast({k} as double) / 5 < {{b}}.x + {{b}}.w then 1 else 0 end)" for k in range(6)) + ")"
_HITS = (_HITS + " * " + _HITS.replace(".x", ".y").replace(".w", ".h")).format(a="a", b="b")
_GAP = "pow(greatest(b.x * 2 - (a.x * 2 + a.w), 0, a.x * 2 + a.w - (b.x + b.w) * 2), 2) + pow(greatest(b.y * 2 - (a.y * 2 + a.h), 0, a.y * 2 + a.h - (b.y + b.h) * 2), 2)"
_OWNERS = f"""pairs as (select a.page_id, a.det_id as box_id, b.det_id as panel_id, {_HITS} as hits, {overlap_sql("a", "b")} as inter, b.w * b.h as area, b.conf >= cast(0.08 as double) as seen, {_GAP} as gap
 from det a join det b on a.page_id = b.page_id and b.cls = 'frame' where a.cls = 'balloon'),
facts as (select *, max(hits) over (partition by page_id, box_id) as top, bool_or(hits >= 9 and seen) over (partition by page_id, box_id) as seen_shared, bool_or(inter > 0 and seen) over (partition by page_id, box_id) as seen_touch, bool_or(inter > 0) over (partition by page_id, box_id) as touch,
 row_number() over (partition by page_id, box_id order by (hits >= 27) desc, area, panel_id) as smallest, row_number() over (partition by page_id, box_id order by seen desc, inter desc, panel_id) as most_seen,
 row_number() over (partition by page_id, box_id order by inter desc, panel_id) as most, row_number() over (partition by page_id, box_id order by gap, panel_id) as nearest from pairs),
owned as (select page_id, box_id, panel_id, case when top >= 27 then case when smallest = 1 then 'whole' end when top >= 18 then case when hits >= 9 and (seen or not seen_shared) then 'shared' end
 when seen_touch then case when most_seen = 1 then 'box' end when touch then case when most = 1 then 'box' end when nearest = 1 then 'nearest' end as rule from facts)"""


@query("j8_owner_cascade", f"{WITH}, {_OWNERS} select page_id, box_id, panel_id, rule from owned where rule is not null")
def owner_cascade(spark, sf):
    return assign.owners(_one(spark, sf, "balloon"), _one(spark, sf, "frame"))


_SLANT = "floor(w * cast(det_id % 3 as double) / 8)"
_SHAPES = f"""shapes as (select *, [{{'x': x + {_SLANT}, 'y': cast(y as double)}}, {{'x': cast(x + w as double), 'y': cast(y as double)}}, {{'x': x + w - {_SLANT}, 'y': cast(y + h as double)}}, {{'x': cast(x as double), 'y': cast(y + h as double)}}] as poly from det where cls = 'frame')"""
_INSIDE = "len(list_filter([0, 1, 2, 3], lambda e: (poly[e + 1].y > {y}) <> (poly[(e + 1) % 4 + 1].y > {y}) and {x} < (poly[(e + 1) % 4 + 1].x - poly[e + 1].x) * ({y} - poly[e + 1].y) / nullif(poly[(e + 1) % 4 + 1].y - poly[e + 1].y, 0) + poly[e + 1].x)) % 2 = 1"
_SHAPED_OWNERS = f"""{_HELD}, {_SHAPES},
focused as (select h.page_id, h.balloon_id, min_by(t.x + t.w / cast(2 as double), t.det_id) as fx, min_by(t.y + t.h / cast(2 as double), t.det_id) as fy from held h join det t on t.page_id = h.page_id and t.det_id = h.text_id where h.n = 1 group by all),
boxes as (select d.*, case when d.x % 3 = 0 then d.x + d.w / cast(2 as double) end as tx, case when d.x % 3 = 0 then cast(d.y + d.h + 40 as double) end as ty, fx, fy from det d left join focused f on f.page_id = d.page_id and f.balloon_id = d.det_id where d.cls = 'balloon'),
points as (select i, j from (select unnest(range(6)) as i), (select unnest(range(6)) as j)),
shares as (select a.page_id, a.det_id as box_id, b.det_id as panel_id, count(*) filter ({_INSIDE.format(x="(a.x + a.w * cast(i as double) / 5)", y="(a.y + a.h * cast(j as double) / 5)")}) as hits from boxes a join shapes b on b.page_id = a.page_id, points group by all),
facts as (select s.*, {overlap_sql("a", "b")} as inter, b.w * b.h as area, {_GAP} as gap, b.conf >= cast(0.08 as double) as seen, coalesce({_INSIDE.format(x="tx", y="ty")} and tx is not null, false) as tailed, coalesce({_INSIDE.format(x="fx", y="fy")} and fx is not null, false) as focused
 from shares s join boxes a on a.page_id = s.page_id and a.det_id = s.box_id join shapes b on b.page_id = s.page_id and b.det_id = s.panel_id),
sums as (select page_id, box_id, count(*) filter (tailed and inter > 0) as tails, max(hits) as top, count(*) filter (hits >= 9 and seen) > 0 as seen_shared, count(*) filter (inter > 0 and seen) > 0 as seen_touch, count(*) filter (inter > 0) > 0 as touch from facts group by all),
sharers as (select f.page_id, f.box_id, f.panel_id, f.focused, count(*) over w as n, count(*) filter (f.focused) over w as n_focused from facts f join sums s on s.page_id = f.page_id and s.box_id = f.box_id where s.top >= 18 and f.hits >= 9 and (f.seen or not s.seen_shared) window w as (partition by f.page_id, f.box_id)),
owned as (select f.page_id, f.box_id, f.panel_id, case when tails = 1 then case when f.tailed and inter > 0 then 'tail' end
  when top >= 27 then case when row_number() over (partition by f.page_id, f.box_id order by (hits >= 27) desc, area, f.panel_id) = 1 then 'whole' end
  when top >= 18 then case when h.n > 1 and h.n_focused = 1 then case when h.focused then 'focus' end when h.n is not null then 'shared' end
  when seen_touch then case when row_number() over (partition by f.page_id, f.box_id order by seen desc, inter desc, f.panel_id) = 1 then 'box' end
  when touch then case when row_number() over (partition by f.page_id, f.box_id order by inter desc, f.panel_id) = 1 then 'box' end
  when row_number() over (partition by f.page_id, f.box_id order by gap, f.panel_id) = 1 then 'nearest' end as rule
 from facts f join sums s on s.page_id = f.page_id and s.box_id = f.box_id left join sharers h on h.page_id = f.page_id and h.box_id = f.box_id and h.panel_id = f.panel_id)"""


def shaped_frames(frames: DataFrame) -> DataFrame:
    """Frames with a slanted outline in their box."""
    slant = F.floor(F.col("w") * (F.col("det_id") % 3).cast("double") / 8)
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, right, bottom = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    return frames.withColumn("polygon", F.array(corner(x + slant, y), corner(right, y), corner(right - slant, bottom), corner(x, bottom)))


@query("j8_owner_shapes", f"{WITH}, {_SHAPED_OWNERS} select page_id, box_id, panel_id, rule from owned where rule is not null")
def owner_shapes(spark, sf):
    """Owners by outline, by the tail's tip and by the centre of the first text that a balloon holds."""
    texts, balloons = _one(spark, sf, "text"), _one(spark, sf, "balloon")
    centre = F.struct((F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"))
    held = assign.texts_in_balloons(texts, balloons).join(texts.select("page_id", F.col("det_id").alias("text_id"), centre.alias("centre")), ["page_id", "text_id"])
    focus = held.groupBy("page_id", F.col("balloon_id").alias("det_id")).agg(F.min_by("centre", "text_id").alias("focus"))
    tail = F.when(F.col("x") % 3 == 0, F.struct((F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") + 40).cast("double").alias("y")))
    return assign.owners(balloons.withColumn("tail", tail).join(focus, ["page_id", "det_id"], "left"), shaped_frames(_one(spark, sf, "frame")))


@query("j9_nearest_box", f"""{WITH}, p as (select a.page_id, a.det_id as box_id, b.det_id as panel_id, cast({_GAP} as bigint) as gap4 from det a join det b on a.page_id = b.page_id and b.cls = 'frame' where a.cls = 'text')
 select page_id, box_id, panel_id, gap4 from (select *, row_number() over (partition by page_id, box_id order by gap4, panel_id) as n from p) where n = 1""")
def nearest_box(spark, sf):
    return assign.nearest_panels(_one(spark, sf, "text"), _one(spark, sf, "frame"))


def _dedupe_sql(cls: str, iou: float) -> str:
    return f"""{RECURSIVE}, r as (select *, row_number() over (partition by page_id order by conf desc, det_id) as place from det where cls = '{cls}'),
walk as (select page_id, cast(0 as bigint) as place, cast([] as struct(det_id bigint, x bigint, y bigint, w bigint, h bigint)[]) as kept from (select distinct page_id from r)
 union all select walk.page_id, r.place, case when len(list_filter(walk.kept, lambda k: {overlap_sql("k", "r")} / cast(k.w * k.h + r.w * r.h - {overlap_sql("k", "r")} as double) >= cast({iou} as double))) = 0
  then list_append(walk.kept, {{'det_id': r.det_id, 'x': r.x, 'y': r.y, 'w': r.w, 'h': r.h}}) else walk.kept end from walk join r on r.page_id = walk.page_id and r.place = walk.place + 1),
last as (select page_id, kept, row_number() over (partition by page_id order by place desc) as n from walk)
select page_id, k.det_id as det_id, k.x as x, k.y as y, k.w as w, k.h as h from (select page_id, unnest(kept) as k from last where n = 1)"""


@query("d1_greedy_dedupe", _dedupe_sql("frame", 0.6))
def greedy_dedupe(spark, sf):
    return ops.deduplicated(_one(spark, sf, "frame")).select("page_id", "det_id", *"xywh")


@query("d1_greedy_dedupe_close", _dedupe_sql("balloon", 0.2))
def greedy_dedupe_close(spark, sf):
    return ops.deduplicated(_one(spark, sf, "balloon"), iou=0.2).select("page_id", "det_id", *"xywh")


_BOX = "struct(det_id bigint, x bigint, y bigint, w bigint, h bigint, conf double)"
_STRUCT = "{{'det_id': {r}.det_id, 'x': {r}.x, 'y': {r}.y, 'w': {r}.w, 'h': {r}.h, 'conf': {r}.conf}}"


@query(
    "j11_rescue",
    f"""{RECURSIVE}, sure as (select page_id, list({_STRUCT.format(r="d")}) as panels from det d where cls = 'frame' and conf >= cast(0.25 as double) group by page_id),
r as (select *, row_number() over (partition by page_id order by conf desc, det_id) as place from det where cls = 'frame' and conf >= cast(0.08 as double) and conf < cast(0.25 as double) and w * h / {PAGE} >= cast(0.1 as double)),
walk as (select p.page_id, cast(0 as bigint) as place, coalesce(sure.panels, []) as panels, cast([] as bigint[]) as added from (select distinct page_id from r) p left join sure on sure.page_id = p.page_id
 union all select walk.page_id, r.place, case when ok then list_append(walk.panels, {_STRUCT.format(r="r")}) else walk.panels end, case when ok then list_append(walk.added, r.det_id) else walk.added end
  from walk join r on r.page_id = walk.page_id and r.place = walk.place + 1, lateral (select coalesce(list_sum(list_transform(walk.panels, lambda k: {overlap_sql("k", "r")})), 0) / cast(r.w * r.h as double) < cast(0.2 as double) as ok)),
last as (select page_id, added, row_number() over (partition by page_id order by place desc) as n from walk)
select l.page_id, d.det_id, d.conf from (select page_id, unnest(added) as det_id from last where n = 1) l join det d on d.page_id = l.page_id and d.det_id = l.det_id""",
)
def rescue(spark, sf):
    return ops.rescued(_one(spark, sf, "frame")).select("page_id", "det_id", "conf")


@query(
    "j6_late_balloons",
    f"""{RECURSIVE}, start as (select page_id, list({_STRUCT.format(r="d")}) as known from det d where cls = 'text' group by page_id),
r as (select *, row_number() over (partition by page_id order by conf desc, det_id) as place from det where cls = 'balloon'),
walk as (select p.page_id, cast(0 as bigint) as place, coalesce(start.known, []) as known, cast([] as bigint[]) as added from (select distinct page_id from r) p left join start on start.page_id = p.page_id
 union all select walk.page_id, r.place, case when ok then list_append(walk.known, {_STRUCT.format(r="r")}) else walk.known end, case when ok then list_append(walk.added, r.det_id) else walk.added end
  from walk join r on r.page_id = walk.page_id and r.place = walk.place + 1, lateral (select len(list_filter(walk.known, lambda k: {overlap_sql("k", "r")} / cast(greatest(k.w * k.h, 1) as double) > cast(0.5 as double))) = 0 as ok)),
last as (select page_id, added, row_number() over (partition by page_id order by place desc) as n from walk)
select page_id, unnest(added) as det_id from last where n = 1""",
)
def late_balloons(spark, sf):
    return ops.late_balloons(_one(spark, sf, "balloon"), _one(spark, sf, "text")).select("page_id", "det_id")


@query(
    "j10_merge_text",
    f"""{RECURSIVE}, a as (select page_id, list({_STRUCT.format(r="d")} order by det_id) as known from det d where cls = 'text' group by page_id),
r as (select *, row_number() over (partition by page_id order by det_id) as place from det where cls = 'balloon'),
pages as (select page_id from a union select page_id from r),
walk as (select p.page_id, cast(0 as bigint) as place, coalesce(a.known, []) as known from pages p left join a on a.page_id = p.page_id
 union all select walk.page_id, r.place, case when hit is null or hit = 0 then list_append(walk.known, {_STRUCT.format(r="r")}) else list_transform(walk.known, lambda k, i: case when i = hit and r.conf > k.conf then {_STRUCT.format(r="r")} else k end) end
  from walk join r on r.page_id = walk.page_id and r.place = walk.place + 1, lateral (select list_position(list_transform(walk.known, lambda k: {overlap_sql("k", "r")} / cast(k.w * k.h + r.w * r.h - {overlap_sql("k", "r")} as double) >= cast(0.4 as double)), true) as hit)),
last as (select page_id, known, row_number() over (partition by page_id order by place desc) as n from walk),
flat as (select page_id, unnest(known) as k, generate_subscripts(known, 1) - 1 as pos from last where n = 1)
select page_id, cast(pos as bigint) as pos, k.det_id as det_id, k.conf as conf from flat""",
)
def merge_text(spark, sf):
    return ops.merged(_one(spark, sf, "text"), _one(spark, sf, "balloon")).select("page_id", "pos", "det_id", "conf")


@query("g9_trimmed_boxes")
def trimmed_boxes(spark, sf):
    return ops.trimmed(_one(spark, sf, "text").select("page_id", "det_id", *"xywh"), _one(spark, sf, "frame"))


@query("d2_join_split")
def join_split(spark, sf):
    return order.joined_splits(ops.deduplicated(_one(spark, sf, "frame")))


@query("g8_fill_around_texts")
def fill_around_texts(spark, sf):
    return order.filled_around(_one(spark, sf, "text"), _one(spark, sf, "frame"))


@query("o1_reading_order")
def reading_order(spark, sf):
    return order.reading_order(_one(spark, sf, "frame"))


@query(
    "o1_reading_order_is_permutation",
    f"{WITH} select page_id, count(*) as panels, count(*) as distinct_places, cast(0 as bigint) as first_place, count(*) - 1 as last_place from det where cls = 'frame' group by page_id",
)
def reading_order_is_permutation(spark, sf):
    ordered = order.reading_order(_one(spark, sf, "frame"))
    return ordered.groupBy("page_id").agg(F.count("*").alias("panels"), F.countDistinct("place").alias("distinct_places"), F.min("place").alias("first_place"), F.max("place").alias("last_place"))


@query("o2_untangled_order")
def untangled_order(spark, sf):
    return order.untangled(_one(spark, sf, "frame"))


@query("o4_confidence_order", f"{WITH} select page_id, det_id, row_number() over (partition by page_id order by conf desc, det_id) as place from det")
def confidence_order(spark, sf):
    return ops.ranked_by_confidence(detections(spark, sf)).select("page_id", "det_id", F.col("place").cast("long").alias("place"))


@query(
    "p2_camera",
    f"""{WITH}, look as (select page_id, det_id, w * h / {PAGE} as scale, w / cast(h as double) as aspect, conf as ink from det where cls = 'frame')
 select page_id, det_id, case when scale >= cast(0.55 as double) then 'pullBack' when ink >= cast(0.42 as double) then 'punchIn' when aspect >= cast(2.1 as double) then 'panH' when aspect <= cast(0.62 as double) then 'tiltV' else 'punchIn' end as kind,
 case when scale >= cast(0.55 as double) then 118 when ink >= cast(0.42 as double) then 122 when aspect >= cast(2.1 as double) or aspect <= cast(0.62 as double) then null else 106 end as start_percent from look""",
)
def camera(spark, sf):
    look = _one(spark, sf, "frame").select("page_id", "det_id", (F.col("w") * F.col("h") / AREA).alias("scale"), (F.col("w") / F.col("h")).alias("aspect"), F.col("conf").alias("ink"))
    wide, tall = F.col("aspect") >= 2.1, F.col("aspect") <= 0.62
    kind = F.when(F.col("scale") >= 0.55, "pullBack").when(F.col("ink") >= 0.42, "punchIn").when(wide, "panH").when(tall, "tiltV").otherwise("punchIn")
    start = F.when(F.col("scale") >= 0.55, 118).when(F.col("ink") >= 0.42, 122).when(wide | tall, F.lit(None)).otherwise(106)
    return look.select("page_id", "det_id", kind.alias("kind"), start.alias("start_percent"))


@query("p3_fx", f"{WITH} select page_id, det_id, case when conf >= cast(0.52 as double) then 'flash' when conf >= cast(0.42 as double) then 'shake' end as fx from det where cls = 'frame'")
def fx(spark, sf):
    return _one(spark, sf, "frame").select("page_id", "det_id", F.when(F.col("conf") >= 0.52, "flash").when(F.col("conf") >= 0.42, "shake").alias("fx"))


_SHOT = """shots as (select page_id, det_id, w, h, conf as tension, least(cast(390 as double) / w, cast(760 as double) / h) as fit, greatest(cast(390 as double) / w, cast(760 as double) / h) as cover from det where cls = 'frame')"""


@query(
    "p12_directed_shot",
    f"""{WITH}, {_SHOT} select page_id, det_id, case when cover / fit >= cast(2.6 as double) then 'pan' when fit < cast(0.55 as double) then 'tour' when tension >= cast(0.55 as double) then 'tense'
 when w / cast(h as double) >= cast(1.8 as double) and tension < cast(0.45 as double) then 'wide' when tension <= cast(0.25 as double) then 'calm' else 'plain' end as shot,
 {micro_sql("cast(1.45 as double) - cast(0.8 as double) * tension")} as speed from shots""",
)
def directed_shot(spark, sf):
    shots = _one(spark, sf, "frame").select("page_id", "det_id", "w", "h", F.col("conf").alias("tension"), F.least(390.0 / F.col("w"), 760.0 / F.col("h")).alias("fit"), F.greatest(390.0 / F.col("w"), 760.0 / F.col("h")).alias("cover"))
    kind = (
        F.when(F.col("cover") / F.col("fit") >= 2.6, "pan").when(F.col("fit") < 0.55, "tour").when(F.col("tension") >= 0.55, "tense")
        .when((F.col("w") / F.col("h") >= 1.8) & (F.col("tension") < 0.45), "wide").when(F.col("tension") <= 0.25, "calm").otherwise("plain")
    )
    return shots.select("page_id", "det_id", kind.alias("shot"), micro(1.45 - 0.8 * F.col("tension")).alias("speed"))


@query(
    "p6_framed",
    f"""{WITH}, {_OWNERS}, grown as (select o.page_id, o.panel_id, min(b.x) as bx, min(b.y) as by_, max(b.x + b.w) as bx2, max(b.y + b.h) as by2 from owned o join det b on b.page_id = o.page_id and b.det_id = o.box_id where rule is not null group by 1, 2)
 select p.page_id, p.det_id as panel_id, least(p.x, coalesce(bx, p.x)) as x, least(p.y, coalesce(by_, p.y)) as y, greatest(p.x + p.w, coalesce(bx2, p.x + p.w)) - least(p.x, coalesce(bx, p.x)) as w, greatest(p.y + p.h, coalesce(by2, p.y + p.h)) - least(p.y, coalesce(by_, p.y)) as h
 from det p left join grown on grown.page_id = p.page_id and grown.panel_id = p.det_id where p.cls = 'frame'""",
)
def framed(spark, sf):
    balloons, panels = _one(spark, sf, "balloon"), _one(spark, sf, "frame")
    return assign.framed(panels.select("page_id", "det_id", *"xywh"), assign.owners(balloons, panels, with_box=True))


@query(
    "p7_frames",
    f"""{WITH}, {_OWNERS} select f.page_id, f.det_id as panel_id, row_number() over (partition by f.page_id order by f.y, f.x, f.det_id) as place, count(distinct o.box_id) as layers
 from det f left join owned o on o.page_id = f.page_id and o.panel_id = f.det_id and o.rule is not null where f.cls = 'frame' group by f.page_id, f.det_id, f.x, f.y""",
)
def frames(spark, sf):
    balloons, panels = _one(spark, sf, "balloon"), _one(spark, sf, "frame")
    return order.frames(panels, assign.owners(balloons, panels))


@query("a1_build_stats", f"{WITH}, {_WHOLE}, n as (select page_id, count(*) filter (cls = 'frame') as panels, count(*) filter (cls = 'balloon') as balloons, count(*) filter (cls = 'text') as texts from det group by page_id) select n.page_id % 10 as book, count(*) as pages, cast(sum(panels) as bigint) as panels, cast(sum(balloons) as bigint) as balloons, cast(sum(texts) as bigint) as texts, count(*) filter (sure_panels = 0) as splashes from n join wp on wp.page_id = n.page_id group by 1")
def build_stats(spark, sf):
    det = detections(spark, sf)
    sure = (F.col("cls") == "frame") & (F.col("conf") >= 0.5) & (F.col("w") * F.col("h") / AREA >= 0.02)
    pages = det.groupBy("page_id").agg(*(F.count_if(F.col("cls") == c).alias(f"{c}s") for c in ("frame", "balloon", "text")), F.count_if(sure).alias("sure"))
    return pages.groupBy((F.col("page_id") % 10).alias("book")).agg(F.count("*").alias("pages"), F.sum("frames").alias("panels"), F.sum("balloons").alias("balloons"), F.sum("texts").alias("texts"), F.count_if(F.col("sure") == 0).alias("splashes"))


@query("a2_class_counts", f"{WITH} select page_id, count(*) filter (cls = 'frame') as frame, count(*) filter (cls = 'balloon') as balloon, count(*) filter (cls = 'text') as text from det group by page_id")
def class_counts(spark, sf):
    kinds = ["frame", "balloon", "text"]
    return detections(spark, sf).groupBy("page_id").pivot("cls", kinds).count().fillna(0, kinds)


@query("a14_merge_sprites", f"{WITH} select page_id, min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h, {micro_sql('cast(sum(w * h * cast(floor(conf * 1000 + cast(0.5 as double)) as bigint)) as double) / 1000 / greatest(sum(w * h), 1)')} as ink from det where cls = 'text' group by page_id")
def merge_sprites(spark, sf):
    area = F.col("w") * F.col("h")
    thousandths = F.floor(F.col("conf") * 1000 + 0.5)
    ink = F.sum(area * thousandths).cast("double") / 1000 / F.greatest(F.sum(area), F.lit(1))
    return _one(spark, sf, "text").groupBy("page_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), micro(ink).alias("ink"))


@query("m1_polygon_area", f"{WITH} select page_id, det_id, cast(w * h as double) as area, cast(2 * (w + h) as double) as outline from det")
def polygon_area(spark, sf):
    polygon = g.Box.of().polygon()
    return detections(spark, sf).select("page_id", "det_id", g.polygon_area(polygon).alias("area"), g.perimeter(polygon).alias("outline"))


@query("m6_clip", f"{WITH} select page_id, det_id, cast(greatest(least(x + w, 500) - x, 0) * h as double) as left_area, cast(greatest(x + w - greatest(x, 500), 0) * h as double) as right_area from det where cls = 'frame'")
def clip(spark, sf):
    polygon, at = g.Box.of().polygon(), F.lit(500.0)
    rows = _one(spark, sf, "frame").select("page_id", "det_id", polygon.alias("p"))
    return rows.select("page_id", "det_id", g.polygon_area(g.clip(F.col("p"), "x", at, True)).alias("left_area"), g.polygon_area(g.clip(F.col("p"), "x", at, False)).alias("right_area"))


@query("m4_contains_point", f"{WITH} select page_id, det_id, 500 >= x and 500 < x + w and 750 >= y and 750 < y + h as inside from det where cls = 'frame'")
def contains_point(spark, sf):
    return _one(spark, sf, "frame").select("page_id", "det_id", g.Box.of().polygon().alias("p")).select("page_id", "det_id", g.contains(F.col("p"), F.lit(500.0), F.lit(750.0)).alias("inside"))


@query("m15_jaggedness", f"{WITH} select page_id, det_id, {micro_sql('cast(4 * (w + h) * (w + h) as double) / (4 * pi() * w * h)')} as jagged, cast(0 as bigint) as tilted from det where cls = 'frame'")
def jaggedness(spark, sf):
    rows = _one(spark, sf, "frame").select("page_id", "det_id", g.Box.of().polygon().alias("p"))
    return rows.select("page_id", "det_id", micro(g.jaggedness(F.col("p"))).alias("jagged"), micro(g.tilt(F.col("p"))).alias("tilted"))


# frames whose upper and lower sides slope
_SLOPED = f"""{WITH}, f as (select page_id, det_id, conf, cast(w as double) as w, cast(h as double) as h, cast(page_id % 5 * 10 as double) as up, cast(det_id % 4 * 15 as double) as down from det where cls = 'frame'),
 e as (select page_id, det_id, conf, w * h - w * up / 2 - w * down / 2 as area, unnest([{{'dx': w, 'dy': up}}, {{'dx': cast(0 as double), 'dy': h - up}}, {{'dx': -w, 'dy': -down}}, {{'dx': cast(0 as double), 'dy': down - h}}]) as d from f),
 l as (select *, sqrt(d.dx * d.dx + d.dy * d.dy) as len, abs(atan2(d.dy, d.dx)) % (pi() / 2) as turn from e),
 k as (select page_id, det_id, any_value(conf) as ink, sum(least(turn, pi() / 2 - turn) / (pi() / 4) * len) / sum(len) as tilted, sum(len) * sum(len) / (4 * pi() * any_value(area)) as jagged from l group by page_id, det_id)"""


def _sloped(spark, sf):
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    box, up, down = g.Box.of(), F.col("page_id") % 5 * 10, F.col("det_id") % 4 * 15
    corners = F.array(at(box.x, box.y), at(box.right, box.y + up), at(box.right, box.bottom), at(box.x, box.bottom - down))
    return _one(spark, sf, "frame").select("page_id", "det_id", "conf", corners.alias("p"))


@query("m16_tilt", f"{_SLOPED} select page_id, det_id, {micro_sql('tilted')} as tilted from k")
def tilted(spark, sf):
    return _sloped(spark, sf).select("page_id", "det_id", micro(g.tilt(F.col("p"))).alias("tilted"))


@query("m17_tension", f"{_SLOPED} select page_id, det_id, {micro_sql('least(1, 0.5 * least(1, greatest(0, (ink - 0.12) / 0.4)) + 0.3 * least(1, greatest(0, (jagged - 1.15) / 0.8)) + 0.2 * least(1, tilted * 4))')} as tension from k")
def tension(spark, sf):
    """From the ink (a detection's confidence stands for it), the ragged outline and the tilt."""
    return _sloped(spark, sf).select("page_id", "det_id", micro(g.tension(F.col("conf"), g.jaggedness(F.col("p")), g.tilt(F.col("p")))).alias("tension"))


_TENSION = "least(cast(1 as double), cast(0.5 as double) * least(cast(1 as double), greatest(cast(0 as double), (conf - cast(0.12 as double)) / cast(0.4 as double))) + cast(0.3 as double) * least(cast(1 as double), greatest(cast(0 as double), (w * cast(2 as double) / h - cast(1.15 as double)) / cast(0.8 as double))) + cast(0.2 as double) * least(cast(1 as double), x / cast(600 as double) * 4))"


@query(
    "w1_smooth_tension",
    f"""{WITH}, t as (select page_id, det_id, {_TENSION} as v from det where cls = 'frame')
 select page_id, det_id, {micro_sql("v")} as tension, {micro_sql("cast(0.6 as double) * v + cast(0.2 as double) * coalesce(lag(v) over s, v) + cast(0.2 as double) * coalesce(lead(v) over s, v)")} as smoothed from t window s as (partition by page_id order by det_id)""",
)
def smooth_tension(spark, sf):
    value = g.tension(F.col("conf"), F.col("w") * 2.0 / F.col("h"), F.col("x") / 600.0)
    return order.smoothed(_one(spark, sf, "frame").select("page_id", "det_id", value.alias("v"))).select("page_id", "det_id", micro(F.col("v")).alias("tension"), micro(F.col("smoothed")).alias("smoothed"))


@query(
    "u1_panel_sources",
    f"""{WITH}, {_WHOLE}, parts as (select page_id, det_id, 'chosen' as source from det where cls = 'frame' and conf >= cast(0.25 as double) union all
 select page_id, det_id, 'doubtful' from det where cls = 'frame' and conf < cast(0.25 as double) and conf >= cast(0.08 as double) union all select page_id, cast(0 as bigint), 'page' from wp where sure_panels = 0)
 select source, count(*) as n, count(distinct page_id) as pages from parts group by source""",
)
def panel_sources(spark, sf):
    det = detections(spark, sf)
    frames_ = det.where("cls = 'frame'")
    part = lambda df, name: df.select("page_id", F.lit(name).alias("source"))
    chosen = part(frames_.where(F.col("conf") >= BROWSER.panel_conf), "chosen")
    doubtful = part(frames_.where((F.col("conf") < BROWSER.panel_conf) & (F.col("conf") >= BROWSER.rescue_conf)), "doubtful")
    whole = part(ops.whole_pages(det).where("whole_page"), "page")
    return chosen.unionByName(doubtful).unionByName(whole).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query(
    "j19_hit_test",
    f"""{WITH}, hits as (select page_id, det_id, row_number() over (partition by page_id order by det_id desc) as last_n, row_number() over (partition by page_id order by det_id) as first_n from det where cls <> 'frame' and 400 between x and x + w and 600 between y and y + h)
 select page_id, max(case when last_n = 1 then det_id end) as topmost, max(case when first_n = 1 then det_id end) as first_hit from hits group by page_id""",
)
def hit_test(spark, sf):
    hits = detections(spark, sf, "balloon", "text").where("400 between x and x + w and 600 between y and y + h")
    return hits.groupBy("page_id").agg(F.max("det_id").alias("topmost"), F.min("det_id").alias("first_hit"))
