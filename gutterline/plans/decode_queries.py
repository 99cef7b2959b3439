"""Queries over decoded output, lifted ink, outlines, pans and reports."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import decode, lift, orphans, outlines, raster, report, timeline
from ..operators.detections import overlaps
from ..sources import archive
from ..sources.shared import new_folder
from .inputs import DETECTIONS_SQL, dealt, detections, micro, micro_sql, table
from .more_queries import LIGHT, D, light
from .profiles import BROWSER
from .raster_queries import _EIGHT, _FOUR, _components_sql, masks
from .registry import query
from .source_queries import _ENTRY, PAGES
from .timeline_queries import EVENTS, events

WITH = f"with {DETECTIONS_SQL}"

_MARGIN = lambda s: f"least(greatest({s} * {D(0.08)}, {D(3)}), {D(12)})"


@query(
    "m13_decode_text",
    f"{WITH}, m as (select *, {_MARGIN('w')} as mx, {_MARGIN('h')} as my from det where conf >= {D(0.3)} and det_id % 3 <> 0), b as (select *, greatest(x - mx, {D(0)}) as x1, greatest(y - my, {D(0)}) as y1, least(x + w + mx, {D(1000)}) as x2, least(y + h + my, {D(1500)}) as y2 from m) select page_id, det_id - 1 as place, det_id % 3 = 2 as free, {micro_sql('x1')} as x, {micro_sql('y1')} as y, {micro_sql('x2 - x1')} as w, {micro_sql('y2 - y1')} as h from b where x2 - x1 >= 2 and y2 - y1 >= 2",
)
def decode_text(spark, sf):
    """Each page's boxes as a detector's flat arrays, unpacked."""
    corners = F.array("x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    pages = detections(spark, sf).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("det_id", (F.col("det_id") % 3).alias("label"), "conf", corners.alias("corners")))).alias("d"))
    outputs = pages.select("page_id", F.col("d.label").alias("labels"), F.flatten("d.corners").alias("boxes"), F.col("d.conf").alias("scores"))
    return decode.decoded_text(outputs, 1000, 1500, BROWSER.text_model_floor).select("page_id", "place", "free", *(micro(F.col(c)).alias(c) for c in "xywh"))


_CHANNELS = 8
_SUM = " + ".join(f"cast(e.embedding[{c + 1}] as double) * cast(ps[{c + 1}][i + 1] as double)" for c in range(_CHANNELS))


@query(
    "m12_decode_masks",
    f"with p as (select list(embedding order by vec_id) as ps from embeddings where vec_id < {_CHANNELS}), s as (select e.vec_id, i % 8 as x, i // 8 as y, {_SUM} as total from embeddings e, p, range(64) r(i)) select vec_id, count(*) as cells, cast(min(x) as bigint) as x, cast(min(y) as bigint) as y from s where total >= 0 and x >= vec_id % 3 and x < 8 - vec_id % 2 and y >= vec_id % 2 and y < 7 group by vec_id",
)
def decode_masks(spark, sf):
    """Masks of all vectors by the prototypes of the first eight."""
    vectors = table(spark, sf, "embeddings")
    first = vectors.where(F.col("vec_id") < _CHANNELS).orderBy("vec_id").collect()  # the model's prototypes: eight rows
    prototypes = np.array([r.embedding for r in first], float).reshape(-1, raster.SIDE, raster.SIDE)
    weights = F.transform(F.slice("embedding", 1, _CHANNELS), lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").alias("id"), weights.alias("coefficients"), (F.col("vec_id") % 3).alias("x1"), (F.col("vec_id") % 2).alias("y1"), (8 - F.col("vec_id") % 2).alias("x2"), F.lit(7).alias("y2"))
    cells = decode.decoded_masks(rows, prototypes).select(F.col("id").alias("vec_id"), F.posexplode("mask").alias("p", "v")).where("v >= 0.5")
    return cells.groupBy("vec_id").agg(F.count("*").alias("cells"), F.min(F.col("p") % 8).cast("long").alias("x"), F.min(F.floor(F.col("p") / 8)).alias("y"))


_AXIS = lambda v: f"least(greatest(({v} + {D(0.5)}) * ({D(8)} / {D(12)}) - {D(0.5)}, {D(0)}), {D(7)})"


@query(
    "m14_bilinear",
    f"with {LIGHT}, l as (select vec_id, list(v order by p) as vs from lt group by 1), a as (select vec_id, vs, i as p, {_AXIS('i % 12')} as sx, {_AXIS('i // 12')} as sy from l, range(144) t(i)), b as (select *, cast(floor(sx) as bigint) as x0, cast(floor(sy) as bigint) as y0, sx - floor(sx) as fx, sy - floor(sy) as fy from a), c as (select *, least(x0 + 1, 7) as x1, least(y0 + 1, 7) as y1 from b), d as (select vec_id, p, fy, vs[y0 * 8 + x0 + 1] + (vs[y0 * 8 + x1 + 1] - vs[y0 * 8 + x0 + 1]) * fx as top, vs[y1 * 8 + x0 + 1] + (vs[y1 * 8 + x1 + 1] - vs[y1 * 8 + x0 + 1]) * fx as low from c) select vec_id, p, cast(floor(top + (low - top) * fy + {D(0.5)}) as bigint) as v from d",
)
def bilinear(spark, sf):
    return light(spark, sf).select("vec_id", F.posexplode(raster.bilinear(F.col("mask"), 8, 12)).alias("p", "v")).select("vec_id", F.col("p").cast("long").alias("p"), "v")


# a lighter raster, so that many blocks are paper
_PAPER = f"{LIGHT}, pl as (select vec_id, p, x, y, least(v + 60, 255) as v from lt), o as (select *, row_number() over (partition by vec_id order by v) - 1 as place, count(*) over (partition by vec_id) as n from pl), t as (select vec_id, max(v) filter (place = cast(floor(n * {D(0.85)}) as bigint)) as tone, count(*) filter (v >= 195) as bright, max(n) as n from o group by 1), al as (select pl.vec_id, p, x, pl.v, tone, cast(floor(greatest(least((tone - pl.v) * 255 / cast(greatest(tone, 1) as double), {D(255)}), {D(0)})) as bigint) as a from pl join t using (vec_id) where tone >= 195 and bright >= n * {D(0.22)})"


def paper(spark, sf):
    return light(spark, sf).select("vec_id", F.transform("mask", lambda v: F.least(v + 60, F.lit(255))).alias("mask"))


@query(
    "m19_ink_by_light",
    f"""with l as (select vec_id, [least(greatest(least(cast(floor({D(128)} + {D(255)} * cast(e as double)) as bigint), 255), 0) + 60, 255) for e in embedding] as vs from embeddings),
 t as (select vec_id, vs, list_sort(vs)[cast(floor(len(vs) * {D(0.85)}) as bigint) + 1] as tone, len([v for v in vs if v >= 195]) as bright from l)
 select vec_id, i as p, cast(floor(greatest(least((tone - vs[i + 1]) * 255 / cast(greatest(tone, 1) as double), {D(255)}), {D(0)})) as bigint) as a from t, range(64) r(i) where tone >= 195 and bright >= len(vs) * {D(0.22)}""",
)
def ink_by_light(spark, sf):
    return paper(spark, sf).select("vec_id", F.posexplode(lift.ink_by_light(F.col("mask"))).alias("p", "a")).select("vec_id", F.col("p").cast("long").alias("p"), "a")


@query(
    "m19_ink_by_color",
    f"with {LIGHT}, c as (select vec_id, p, x, y, v as r, 255 - v as g, least(v + 60, 255) as b from lt), u as (select vec_id, k, v, row_number() over (partition by vec_id, k order by v) - 1 as place, count(*) over (partition by vec_id, k) as n from (select vec_id, 'r' as k, r as v from c where x in (0, 7) or y in (0, 7) union all select vec_id, 'g', g from c where x in (0, 7) or y in (0, 7) union all select vec_id, 'b', b from c where x in (0, 7) or y in (0, 7))), m as (select vec_id, max(v) filter (k = 'r' and place = n // 2) as mr, max(v) filter (k = 'g' and place = n // 2) as mg, max(v) filter (k = 'b' and place = n // 2) as mb from u group by 1), a as (select vec_id, p, cast(floor(greatest(least((sqrt(cast((r - mr) * (r - mr) + (g - mg) * (g - mg) + (b - mb) * (b - mb) as double)) - 40) * 255 / 100, {D(255)}), {D(0)})) as bigint) as a from c join m using (vec_id)) select vec_id, cast(sum(a) as bigint) as ink, count(*) filter (a = 0) as flat from a group by 1 having count(*) filter (a = 0) >= {D(0.3)} * count(*)",
)
def ink_by_color(spark, sf):
    red = F.col("mask")
    alpha = lift.ink_by_color(red, F.transform(red, lambda v: F.lit(255) - v), F.transform(red, lambda v: F.least(v + 60, F.lit(255))), 8)
    rows = light(spark, sf).select("vec_id", alpha.alias("a")).where("a is not null")
    return rows.select("vec_id", F.aggregate("a", F.lit(0).cast("long"), lambda s, a: s + a).alias("ink"), F.size(F.filter("a", lambda a: a == 0)).cast("long").alias("flat"))


@query("m21_sprite", f"with {_PAPER}, s as (select *, cast(floor(a * ((x + 1) / {D(8)}) + {D(0.5)}) as bigint) as sa from al) select vec_id, count(*) filter (sa > 40) as taken, cast(sum(case when sa > 40 then tone else v end) as bigint) as art from s group by 1")
def sprite(spark, sf):
    """Ink under a cover that fades to the left, and the art without it."""
    cover = F.lit([(i % 8 + 1) / 8 for i in range(64)])
    rows = paper(spark, sf).where(lift.safe(F.col("mask"))).withColumn("a", lift.sprite_alpha(lift.ink_by_light(F.col("mask")), cover))
    art = lift.erased(F.col("mask"), F.col("a"), lift.paper_tone(F.col("mask")))
    return rows.select("vec_id", lift.taken(F.col("a")).cast("long").alias("taken"), F.aggregate(art, F.lit(0).cast("long"), lambda s, v: s + v).alias("art"))


@query("f13_readable", f"{_components_sql(_EIGHT)} select vec_id, sum(area) >= {D(0.005)} * 64 and count(*) filter (area >= 2) >= 2 and max(area) <= {D(0.86)} * sum(area) as readable, sum(area) >= 12 as trusted from numbered group by vec_id")
def readable(spark, sf):
    """Ink that is spread like letters; a person's word needs less of it."""
    found = raster.components(masks(spark, sf)).groupBy("vec_id").agg(F.count_if(F.col("area") >= 2).alias("blobs"), F.max("area").alias("largest"), F.sum("area").alias("ink"))
    return found.select("vec_id", ((F.col("ink") >= 0.005 * 64) & (F.col("blobs") >= 2) & (F.col("largest") <= 0.86 * F.col("ink"))).alias("readable"), (F.col("ink") >= 12).alias("trusted"))


@query("f14_orphan_gates", f"{_components_sql(_FOUR)} select vec_id, label, area from numbered where area / {D(64)} >= {D(0.06)} and w / {D(8)} >= {D(0.12)} and h / {D(8)} >= {D(0.12)} and area / cast(w * h as double) >= {D(0.6)}")
def orphan_gates(spark, sf):
    return orphans.solid(raster.components(masks(spark, sf), diagonal=False)).select("vec_id", "label", "area")


@query("g7_orphans")
def orphan_zones(spark, sf):
    """Dark zones of each raster that its two panels leave uncovered."""
    grid = table(spark, sf, "embeddings").select(F.col("vec_id").alias("page_id"), raster.ink_of(F.col("embedding"), 0.1).alias("mask"))
    box = lambda k, x, y: F.struct(F.lit(k).cast("long").alias("det_id"), F.lit("frame").alias("cls"), x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(3).cast("long").alias("w"), F.lit(3).cast("long").alias("h"), F.lit(0.9).alias("conf"))
    panels = grid.select("page_id", F.explode(F.array(box(1, F.col("page_id") % 5, F.col("page_id") % 3), box(2, F.col("page_id") % 4, 5 - F.col("page_id") % 2))).alias("p")).select("page_id", "p.*")
    return orphans.orphans(grid, panels)


def _slanted(box: str):
    """A trapezoid in a box: its lower side is shorter."""
    of = g.Box.field(F.col(box))
    cut = of.w * (F.col(f"{box}.det_id") % 4) / 10
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(of.x, of.y), point(of.right, of.y), point(of.right - cut, of.bottom), point(of.x + cut, of.bottom))


@query("j2_polygon_iou")
def polygon_iou(spark, sf):
    """Overlap of the outlines of balloons whose boxes meet."""
    balloons = detections(spark, sf, "balloon").select("page_id", "det_id", "x", "y", "w", "h")
    pairs = overlaps(balloons, balloons).where("a.det_id < b.det_id")
    pairs = pairs.select("page_id", F.col("a.det_id").alias("a_id"), F.col("b.det_id").alias("b_id"), _slanted("a").alias("a_polygon"), _slanted("b").alias("b_polygon"))
    return outlines.with_iou(pairs).withColumn("iou", micro(F.col("iou")))


@query("m23_tail_tips")
def tail_tips(spark, sf):
    """Balloons with a spike from their lower side, a quarter of their size."""
    x, y, w, h = (F.col(c) / 4 for c in "xywh")
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    spike = [point(x + w * 0.56, y + h), point(x + w / 2 + F.col("det_id") * 3, y + h + 20), point(x + w * 0.44, y + h)]
    shape = F.array(point(x, y), point(x + w, y), point(x + w, y + h), *spike, point(x, y + h))
    balloons = detections(spark, sf, "balloon").select("page_id", "det_id", shape.alias("polygon"))
    return outlines.tail_tips(dealt(balloons, outlines.shape_key(F.col("polygon"))))


_SLACK = 6  # twelve pixels of the screen at twice the scale


@query(
    "j20_pick_with_slack",
    f"{WITH}, p as (select page_id, det_id, x + w / {D(2)} as px, y + h / {D(2)} as py from det where cls = 'text'), k as (select p.page_id, p.det_id as text_id, b.det_id as balloon_id, row_number() over (partition by p.page_id, p.det_id order by b.det_id) as n from p join det b on b.page_id = p.page_id and b.cls = 'balloon' and px between b.x - {_SLACK} and b.x + b.w + {_SLACK} and py between b.y - {_SLACK} and b.y + b.h + {_SLACK}) select page_id, text_id, balloon_id from k where n = 1",
)
def pick_with_slack(spark, sf):
    """The first balloon that a tap near its box picks."""
    taps = detections(spark, sf, "text").select("page_id", F.col("det_id").alias("text_id"), (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"))
    near = F.col("px").between(F.col("x") - _SLACK, F.col("x") + F.col("w") + _SLACK) & F.col("py").between(F.col("y") - _SLACK, F.col("y") + F.col("h") + _SLACK)
    return taps.join(detections(spark, sf, "balloon"), "page_id").where(near).groupBy("page_id", "text_id").agg(F.min("det_id").alias("balloon_id"))


@query("a23_first_fx", f"with {EVENTS}, r as (select key, tag, row_number() over (partition by key order by t, event_id) as n from ev where tag in ('click', 'purchase')) select k.key, r.tag as fx from (select distinct key from ev) k left join r on r.key = k.key and r.n = 1")
def first_fx(spark, sf):
    """The first effect of each panel; null where it has none."""
    fx = F.when(F.col("tag").isin("click", "purchase"), F.struct("t", "event_id", "tag"))
    return events(spark, sf).groupBy("key").agg(F.min(fx)["tag"].alias("fx"))


_STOPS, _PAN_MS, _PAN_DELAY = [300_000, 600_000], 900, 120
_TICKS = f"tk as (select key, t, event_id, 16 + cast(floor(value) as bigint) as dt, count(*) filter (tag = 'purchase') over (partition by key order by t, event_id) as revealed, row_number() over (partition by key order by t, event_id) as i from ev)"


@query(
    "r20_pan_gates",
    f"with recursive {EVENTS}, {_TICKS}, walk as (select key, cast(0 as bigint) as i, cast(0 as bigint) as place, cast({_PAN_DELAY} as bigint) as delay, cast(null as bigint) as event_id from (select distinct key from ev) union all select w.key, tk.i, case when w.delay > 0 then w.place else least(w.place + tk.dt * 1000000 // {_PAN_MS}, case tk.revealed when 0 then {_STOPS[0]} when 1 then {_STOPS[1]} else 1000000 end) end, case when w.delay > 0 then w.delay - tk.dt else w.delay end, tk.event_id from walk w join tk on tk.key = w.key and tk.i = w.i + 1) select key, event_id, place, place >= 1000000 as done from walk where i > 0",
)
def pan_gates(spark, sf):
    """A pan that waits at each stop until it is revealed."""
    order = Window.partitionBy("key").orderBy("t", "event_id")
    ticks = events(spark, sf).select("key", "t", "event_id", (F.floor("value") + 16).cast("long").alias("dt"), F.count_if(F.col("tag") == "purchase").over(order).alias("revealed"))
    return timeline.pan_progress(ticks, _STOPS, _PAN_MS, _PAN_DELAY).select("key", "event_id", "place", (F.col("place") >= 1_000_000).alias("done"))


@query("p1_projections", f"{WITH} select page_id, det_id, w * h as area, {micro_sql(f'w / {D('h')}')} as aspect, {micro_sql(f'w * h / {D(1500000)}')} as scale, x + w as x2, y + h as y2 from det")
def projections(spark, sf):
    box = g.Box.of()
    return detections(spark, sf).select("page_id", "det_id", box.area.alias("area"), micro(box.w / box.h).alias("aspect"), micro(box.area / BROWSER.page_area).alias("scale"), box.right.alias("x2"), box.bottom.alias("y2"))


@query("m28_reveal_easing", f"with {EVENTS}, s as (select event_id, least(greatest(value / {D(80)}, {D(0)}), {D(1)}) as p from ev) select event_id, {micro_sql(f'1 + {D(0.07)} * sin({D(math.pi)} * p) * (1 - p)')} as size, {micro_sql('p')} as alpha, {micro_sql(f'pow(1 - p, {D(1.6)})')} as blur from s")
def reveal_easing(spark, sf):
    """A balloon enters a little larger and blurred, and settles."""
    p = F.least(F.greatest(F.col("value") / 80, F.lit(0.0)), F.lit(1.0))
    return events(spark, sf).select("event_id", micro(1 + F.lit(0.07) * F.sin(F.lit(math.pi) * p) * (1 - p)).alias("size"), micro(p).alias("alpha"), micro(F.pow(1 - p, F.lit(1.6))).alias("blur"))


@query("o5_best_candidate", f"{WITH}, r as (select page_id, cls, det_id, row_number() over (partition by page_id, cls order by conf desc, det_id) as n from det) select page_id, cls, det_id from r where n = 1")
def best_candidate(spark, sf):
    best = F.min(F.struct((-F.col("conf")).alias("worst"), "det_id"))
    return detections(spark, sf).groupBy("page_id", "cls").agg(best["det_id"].alias("det_id"))


def _report(spark, sf):
    timings = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), (F.col("o_orderkey") * 37 % 900 + 100).cast("double").alias("ms"))
    return report.written(report.pages(detections(spark, sf), timings), new_folder(spark, "report"))


_MS = "cast(o_orderkey * 37 % 900 + 100 as double)"
_PER_PAGE = f"{WITH}, pg as (select cast(page_id as varchar) as page, {_MS} as ms, count(*) filter (cls = 'frame') as frame, count(*) filter (cls = 'balloon') as balloon, count(*) filter (cls = 'text') as text, max(det_id) as dets from det join orders on o_orderkey = page_id group by page_id, o_orderkey)"


@query("s22_report_pages", f"{_PER_PAGE} select * from pg")
def report_pages(spark, sf):
    """The report written as JSON and read back."""
    return _report(spark, sf).select("page", "ms", "counts.*", F.size("dets").cast("long").alias("dets"))


@query("s22_report_totals", f"{_PER_PAGE}, r as (select *, row_number() over (order by ms) - 1 as place, count(*) over () as n from pg) select max(n) as pages, cast(sum(frame) as bigint) as frame, cast(sum(balloon) as bigint) as balloon, cast(sum(text) as bigint) as text, {micro_sql('avg(ms)')} as mean_ms, max(ms) filter (place = n // 2) as median_ms from r")
def report_totals(spark, sf):
    return report.totals(_report(spark, sf)).select("pages", *report.CLASSES, micro(F.col("mean_ms")).alias("mean_ms"), "median_ms")


@query("s22_gallery", f"{_PER_PAGE} select page, '<figure><figcaption><span>' || page || '</span> ' || frame || ' frames, ' || balloon || ' balloons, ' || text || ' texts, ' || cast(ms as bigint) || ' ms</figcaption></figure>' as card from pg")
def gallery(spark, sf):
    return report.cards(_report(spark, sf))


@query("s4_archive_entry", f"select cast(page_id // {PAGES} as varchar) as book, {_ENTRY} as name, sha256(coalesce(html, '')) as digest from pages where page_id = 3")
def archive_entry(spark, sf):
    """One entry by name; nothing else is inflated."""
    path = new_folder(spark, "books")
    archive.write_books(table(spark, sf, "pages").select(F.expr(f"page_id div {PAGES}").alias("book"), F.expr(_ENTRY).alias("name"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("data")), path)
    return archive.read_books(spark, path).where(F.col("name") == "p00000003.html").select("book", "name", F.sha2("data", 256).alias("digest"))


@query("s5_archive_kind", "select page_id, case page_id % 3 when 0 then 'rar' when 1 then 'zip' end as kind from pages")
def archive_kind(spark, sf):
    """What a file is by its first bytes."""
    magic = F.when(F.col("page_id") % 3 == 0, F.unhex(F.lit("526172211A0700"))).when(F.col("page_id") % 3 == 1, F.unhex(F.lit("504B0304"))).otherwise(F.unhex(F.lit("00")))
    content = F.concat(magic, F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    return table(spark, sf, "pages").select("page_id", archive.kind_of(content).alias("kind"))
