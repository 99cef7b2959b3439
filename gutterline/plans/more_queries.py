"""Queries over the smaller rules: looks, camera, order statistics, notes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import camera as cam
from ..functions import geometry as g
from ..operators import raster
from ..operators.detections import overlaps
from .inputs import DETECTIONS_SQL, detections, micro, micro_sql, overlap_sql, table
from .raster_queries import GRID, masks
from .registry import query
from .timeline_queries import EVENTS, events

WITH = f"with {DETECTIONS_SQL}"
D = lambda v: f"cast({v} as double)"

# brightness 0..255 of a raster's cells
LIGHT = f"lt as (select vec_id, i as p, i % 8 as x, i // 8 as y, greatest(least(cast(floor({D(128)} + {D(255)} * cast(embedding[i + 1] as double)) as bigint), 255), 0) as v from embeddings, range(64) r(i))"


def light(spark, sf):
    level = F.transform("embedding", lambda v: F.greatest(F.least(F.floor(F.lit(128.0) + F.lit(255.0) * v.cast("double")), F.lit(255)), F.lit(0)))
    return table(spark, sf, "embeddings").select("vec_id", level.alias("mask"))


_BORDER = "x = 0 or y = 0 or x = 7 or y = 7"


@query("f10_on_dark", f"with {LIGHT}, b as (select vec_id, v, row_number() over (partition by vec_id order by v) - 1 as place, count(*) over (partition by vec_id) as n from lt where x in (0, 7) or y in (0, 7)) select vec_id, max(case when place = n // 2 then v end) as median, max(case when place = n // 2 then v end) < 90 and count(*) filter (v < 60) >= {D(0.55)} * max(n) as dark from b group by vec_id")
def on_dark(spark, sf):
    border = F.sort_array(F.filter("mask", lambda v, p: (p % 8 == 0) | (p % 8 == 7) | (p < 8) | (p >= 56)))
    rows = light(spark, sf).select("vec_id", border.alias("b"))
    median, dark = F.get("b", F.floor(F.size("b") / 2).cast("int")), F.size(F.filter("b", lambda v: v < 60))
    return rows.select("vec_id", median.alias("median"), ((median < 90) & (dark >= F.size("b") * 0.55)).alias("dark"))


@query("f11_safe_to_lift", f"with {LIGHT}, b as (select vec_id, v, row_number() over (partition by vec_id order by v) - 1 as place, count(*) over (partition by vec_id) as n from lt) select vec_id, max(case when place = cast(floor(n * {D(0.85)}) as bigint) then v end) >= 195 and count(*) filter (v >= 195) >= {D(0.22)} * max(n) as safe from b group by vec_id")
def safe_to_lift(spark, sf):
    ordered, n = F.sort_array("mask"), F.size("mask")
    bright = F.get(ordered, F.floor(n * 0.85).cast("int")) >= 195
    return light(spark, sf).select("vec_id", (bright & (F.size(F.filter("mask", lambda v: v >= 195)) >= n * 0.22)).alias("safe"))


@query("a8_fill_tone", f"with {LIGHT} select vec_id, {micro_sql('quantile_cont(cast(v as double), cast(0.85 as double))')} as tone, count(*) filter (v >= 195) as paper from lt group by vec_id")
def fill_tone(spark, sf):
    """The interpolated percentile, as the command-line profile takes it."""
    cells = raster.cells(light(spark, sf)).groupBy("vec_id")
    return cells.agg(micro(F.percentile("v", 0.85)).alias("tone"), F.count_if(F.col("v") >= 195).alias("paper"))


@query("a9_backdrop", f"with {LIGHT}, b as (select vec_id, v, row_number() over (partition by vec_id order by v) - 1 as place, count(*) over (partition by vec_id) as n from lt where x in (0, 7) or y in (0, 7)) select vec_id, max(v) filter (place = n // 2) as backdrop, min(v) as darkest, max(v) as lightest from b group by vec_id")
def backdrop(spark, sf):
    border = raster.cells(light(spark, sf)).where(_BORDER)
    ranked = border.withColumn("place", F.row_number().over(Window.partitionBy("vec_id").orderBy("v")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("vec_id")))
    return ranked.groupBy("vec_id").agg(F.max(F.when(F.col("place") == F.floor(F.col("n") / 2), F.col("v"))).alias("backdrop"), F.min("v").alias("darkest"), F.max("v").alias("lightest"))


@query("a7_dark_blocks", f"with {LIGHT}, b as (select vec_id, x // 2 as bx, y // 2 as by_, count(*) filter (v < 110) as dark from lt group by 1, 2, 3) select vec_id, count(*) filter (dark = 4) as solid, count(*) as blocks from b group by vec_id")
def dark_blocks(spark, sf):
    blocks = raster.cells(light(spark, sf)).groupBy("vec_id", F.floor(F.col("x") / 2).alias("bx"), F.floor(F.col("y") / 2).alias("by_")).agg(F.count_if(F.col("v") < 110).alias("dark"))
    return blocks.groupBy("vec_id").agg(F.count_if(F.col("dark") == 4).alias("solid"), F.count("*").alias("blocks"))


@query("w10_area_resample", f"with {LIGHT} select vec_id, x // 2 as x, y // 2 as y, cast(sum(v) as bigint) as four_times from lt group by 1, 2, 3")
def area_resample(spark, sf):
    """Half size by area: each cell is the mean of four."""
    return raster.cells(light(spark, sf)).groupBy("vec_id", F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(F.sum("v").alias("four_times"))


@query("g5_gutter_rows", f"with {GRID}, r as (select vec_id, y, cast(sum(v) as bigint) as filled from px group by 1, 2), s as (select *, coalesce(lag(filled, 1) over w, 0) + coalesce(lag(filled, 2) over w, 0) as above, count(*) over w as seen from r window w as (partition by vec_id order by y)) select vec_id, min(y) as cut from s where seen > 2 and filled * 2 <= 1 and above >= 4 group by vec_id")
def gutter_rows(spark, sf):
    """The first nearly empty row under a filled band: where a zone is cut."""
    rows = raster.cells(masks(spark, sf)).groupBy("vec_id", "y").agg(F.sum("v").alias("filled"))
    order = Window.partitionBy("vec_id").orderBy("y")
    above = F.coalesce(F.lag("filled", 1).over(order), F.lit(0)) + F.coalesce(F.lag("filled", 2).over(order), F.lit(0))
    return rows.withColumn("above", above).withColumn("seen", F.row_number().over(order)).where("seen > 2 and filled * 2 <= 1 and above >= 4").groupBy("vec_id").agg(F.min("y").alias("cut"))


_LOOK = f"look as (select page_id, det_id, w * h / {D(1500000)} as scale, w / {D('h')} as aspect, conf as ink, (x % 100) / {D(100)} as streaks from det where cls = 'frame'), lk as (select *, scale >= {D(0.55)} as splash, aspect >= {D(2.1)} as wide, aspect <= {D(0.62)} as tall, ink >= {D(0.34)} and streaks >= {D(0.22)} as action, least({D(1)}, ink * {D(1.15)} + streaks * {D(0.75)}) as hit from look)"


def _looks(spark, sf):
    rows = detections(spark, sf, "frame").select("page_id", "det_id", (F.col("w") * F.col("h") / 1500000.0).alias("scale"), (F.col("w") / F.col("h")).alias("aspect"), F.col("conf").alias("ink"), (F.col("x") % 100 / 100.0).alias("streaks"))
    flags = cam.look_flags(*(F.col(c) for c in ("scale", "aspect", "ink", "streaks")))
    return rows, flags, cam.punch(F.col("ink"), F.col("streaks"))


@query("p4_look", f"{WITH}, {_LOOK} select page_id, det_id, splash, wide, tall, action, {micro_sql('hit')} as punch from lk")
def look(spark, sf):
    rows, flags, hit = _looks(spark, sf)
    return rows.select("page_id", "det_id", *(c.alias(n) for n, c in flags.items()), micro(hit).alias("punch"))


@query(
    "p5_enter_hold",
    f"{WITH}, {_LOOK} select page_id, det_id, case when splash then 900 when action then cast(trunc({D(150)} + {D(120)} * ({D(1)} - hit)) as int) when wide or tall then 700 else 450 end as enter_ms, cast(trunc(({D(420)} + {D(1400)} * least(scale * {D(2.2)}, {D(1)})) * case when action then {D(0.62)} else {D(1)} end) as int) as hold_ms from lk",
)
def enter_hold(spark, sf):
    rows, flags, hit = _looks(spark, sf)
    return rows.select("page_id", "det_id", cam.enter_ms(flags, hit).alias("enter_ms"), cam.hold_ms(flags, F.col("scale")).alias("hold_ms"))


@query("p3_fx_cli", f"{WITH}, {_LOOK} select page_id, det_id, case when streaks >= {D(0.55)} then 'speedlines' when ink >= {D(0.52)} then 'flash' when action then 'shake' end as fx from lk")
def fx_cli(spark, sf):
    rows, flags, _ = _looks(spark, sf)
    return rows.select("page_id", "det_id", F.when(F.col("streaks") >= 0.55, "speedlines").when(F.col("ink") >= 0.52, "flash").when(flags["action"], "shake").alias("fx"))


@query("p8_page_frames", "select conv_id, 0 as seq, 'cut' as kind, (rank() over (order by conv_id)) || ' / ' || count(*) over () as label from (select distinct conv_id from conversations)")
def page_frames(spark, sf):
    """One frame for each page with a single cut, and its label.  Places are
    counted in ranges of pages and shifted by the ranges before, these in turn
    by the spans of ranges before: each window but the last, over a row for
    each million of page numbers, is bounded."""
    pages = table(spark, sf, "conversations").select("conv_id").distinct().withColumn("range", F.floor(F.col("conv_id") / 1000))
    sizes = pages.groupBy("range").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("range") / 1000))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sizes.groupBy("span").agg(F.sum("n").alias("n")).select("span", earlier(Window.orderBy("span")).alias("spans_before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    before = sizes.withColumn("ranges_before", earlier(Window.partitionBy("span").orderBy("range"))).join(spans, "span").select("range", (F.col("ranges_before") + F.col("spans_before")).alias("before"), "total")
    placed = pages.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy("conv_id"))).join(before, "range")
    return placed.select("conv_id", F.lit(0).alias("seq"), F.lit("cut").alias("kind"), F.format_string("%d / %d", F.col("place") + F.col("before"), F.col("total")).alias("label"))


@query("p11_framing", f"{WITH} select page_id, det_id, case when w * h / {D(1500000)} >= {D(0.55)} then 'wide' when w / {D('h')} >= {D(2.1)} then 'right' when w / {D('h')} <= {D(0.62)} then 'top' else 'centre' end as from_part from det where cls = 'frame'")
def framing(spark, sf):
    rows, flags, _ = _looks(spark, sf)
    return rows.select("page_id", "det_id", F.when(flags["splash"], "wide").when(flags["wide"], "right").when(flags["tall"], "top").otherwise("centre").alias("from_part"))


@query("p13_camera_fit", f"{WITH}, s as (select *, least({D(390)} / w, {D(760)} / h) as scale from det where cls = 'frame') select page_id, det_id, {micro_sql('scale')} as scale, {micro_sql(f'{D(195)} - (x + w / {D(2)}) * scale')} as x, {micro_sql(f'{D(380)} - (y + h / {D(2)}) * scale')} as y from s")
def camera_fit(spark, sf):
    rows = detections(spark, sf, "frame").select("page_id", "det_id", cam.fit(g.Box.of(), 390, 760).alias("t"))
    return rows.select("page_id", "det_id", *(micro(F.col(f"t.{c}")).alias(c) for c in ("scale", "x", "y")))


_GROW = "least(greatest({s} * cast(0.08 as double), 3), 12)"


@query("p14_grown_text", f"{WITH}, m as (select *, {_GROW.format(s='w')} as mx, {_GROW.format(s='h')} as my from det where cls = 'text'), b as (select page_id, det_id, greatest(x - mx, 0) as x, greatest(y - my, 0) as y, least(x + w + mx, 1000) as r, least(y + h + my, 1500) as b from m) select page_id, det_id, {micro_sql('x')} as x, {micro_sql('y')} as y, {micro_sql('r - x')} as w, {micro_sql('b - y')} as h from b")
def grown_text(spark, sf):
    rows = detections(spark, sf, "text").select("page_id", "det_id", cam.grown(g.Box.of(), 1000, 1500).alias("b"))
    return rows.select("page_id", "det_id", *(micro(F.col(f"b.{c}")).alias(c) for c in "xywh"))


@query("p15_letterbox", f"{WITH}, s as (select page_id, det_id, w, h, least({D(640)} / w, {D(640)} / h) as scale from det) select page_id, det_id, {micro_sql('scale')} as scale, cast(floor(w * scale + {D(0.5)}) as bigint) as w, cast(floor(h * scale + {D(0.5)}) as bigint) as h from s")
def letterbox(spark, sf):
    rows = detections(spark, sf).select("page_id", "det_id", cam.letterbox(F.col("w"), F.col("h"), 640).alias("b"))
    return rows.select("page_id", "det_id", micro(F.col("b.scale")).alias("scale"), "b.w", "b.h")


@query(
    "p16_zoom_limits",
    f"""{WITH}, l as (select page_id, det_id, x, y, {D(0.5)} + conf * 8 as factor, least({D(800)} / w, {D(600)} / h) * {D(0.8)} as low, least({D(800)} / w, {D(600)} / h) * 6 as high from det),
 z as (select *, case when factor > 1 then least(2 * factor, greatest(high, {D(2)})) else greatest(2 * factor, least(low, {D(2)})) end as scale from l)
 select page_id, det_id, {micro_sql('low')} as low, {micro_sql('high')} as high, {micro_sql('scale')} as scale, {micro_sql('400 - (400 - x) * (scale / 2)')} as x, {micro_sql('300 - (300 - y) * (scale / 2)')} as y from z""",
)
def page_zoom(spark, sf):
    """Zooming by a factor around the middle of an 800 x 600 view, on a page of a detection's size."""
    rows = detections(spark, sf).withColumn("limits", cam.zoom_limits(F.col("w"), F.col("h"), 800, 600))
    after = cam.zoomed_at(F.lit(2.0), F.col("x"), F.col("y"), 0.5 + F.col("conf") * 8, F.lit(400), F.lit(300), F.col("limits"))
    rows = rows.select("page_id", "det_id", "limits", after.alias("a"))
    return rows.select("page_id", "det_id", micro(F.col("limits.low")).alias("low"), micro(F.col("limits.high")).alias("high"), *(micro(F.col(f"a.{c}")).alias(c) for c in ("scale", "x", "y")))


@query("m26_shake", f"{WITH}, s as (select page_id, det_id, w % 20 as amp, h as ms, x as elapsed from det where cls = 'frame') select page_id, det_id, {micro_sql('amp * (greatest(ms - elapsed, 0) / cast(greatest(ms, 1) as double)) * (greatest(ms - elapsed, 0) / cast(greatest(ms, 1) as double))')} as amplitude, {micro_sql('x_low')} as furthest_left from (select *, 100 - amp * (greatest(ms - elapsed, 0) / cast(greatest(ms, 1) as double)) * (greatest(ms - elapsed, 0) / cast(greatest(ms, 1) as double)) as x_low from s)")
def shake(spark, sf):
    """How far a shake throws the picture, and the furthest that it puts x = 100 to the left."""
    rows = detections(spark, sf, "frame").select("page_id", "det_id", cam.shake_amplitude(F.col("w") % 20, F.col("h"), F.col("x")).alias("a"))
    return rows.select("page_id", "det_id", micro(F.col("a")).alias("amplitude"), micro(cam.shaken(F.lit(100), F.col("a"), F.lit(0.0))).alias("furthest_left"))


@query("m25_zoom_limits", f"with {EVENTS} select event_id, {micro_sql(f'case when value / {D(50)} > 1 then least({D(1)} * value / {D(50)}, greatest({D(1.5)}, {D(1)})) else greatest({D(1)} * value / {D(50)}, least({D(0.2)}, {D(1)})) end')} as scale from ev")
def zoom_limits(spark, sf):
    return events(spark, sf).select("event_id", micro(cam.zoomed(F.lit(1.0), F.col("value") / 50, 0.2, 1.5)).alias("scale"))


@query("m24_camera_glide", f"with {EVENTS} select event_id, cast(floor(({D(100)} + ({D(0)} - {D(100)}) * exp({D(-5)} * value / {D(450)})) * 1000 + {D(0.5)}) as bigint) as at from ev")
def camera_glide(spark, sf):
    at = cam.glided(F.lit(0.0), F.lit(100.0), F.col("value"), 450)
    return events(spark, sf).select("event_id", F.floor(at * 1000 + 0.5).alias("at"))


_LEVEL = lambda k: f"greatest(least(cast(floor({D(128)} + {D(255)} * cast(embedding[{k}] as double)) as bigint), 255), 0)"


@query("m18_luma", f"select vec_id, i * 3 as p, {micro_sql(f'{_LEVEL("i * 3 + 1")} * {D(0.299)} + {_LEVEL("i * 3 + 2")} * {D(0.587)} + {_LEVEL("i * 3 + 3")} * {D(0.114)}')} as luma from embeddings, range(21) r(i)")
def luma(spark, sf):
    pixel = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct((i * 3).cast("long").alias("p"), cam.luma(F.get("mask", i * 3), F.get("mask", i * 3 + 1), F.get("mask", i * 3 + 2)).alias("y")))
    return light(spark, sf).select("vec_id", F.explode(pixel).alias("c")).select("vec_id", "c.p", micro(F.col("c.y")).alias("luma"))


@query("p17_moods", "with m as (select * from (values ('calm', 0), ('tense', 1), ('sad', 2), ('epic', 3)) v(mood, k)) select conv_id, turn, mood from conversations join m on k = (conv_id + turn) % 4")
def moods(spark, sf):
    kinds = spark.createDataFrame([("calm", 0), ("tense", 1), ("sad", 2), ("epic", 3)], "mood string, k long")
    return table(spark, sf, "conversations").join(F.broadcast(kinds), (F.col("conv_id") + F.col("turn")) % 4 == F.col("k")).select("conv_id", "turn", "mood")


@query("p19_messages", f"with {EVENTS}, m as (select * from (values ('linkMissing', 'No file there'), ('linkPrivate', 'Not shared'), ('linkHttp', 'Status %d'), ('linkPage', 'A page, not a file')) v(code, message)), c as (select event_id, cast(floor(value) as int) as n, case cast(floor(value) as bigint) % 4 when 0 then 'linkMissing' when 1 then 'linkPrivate' when 2 then 'linkHttp' else 'linkPage' end as code from ev) select event_id, replace(message, '%d', cast(n as varchar)) as message from c join m using (code)")
def messages(spark, sf):
    texts = spark.createDataFrame([("linkMissing", "No file there"), ("linkPrivate", "Not shared"), ("linkHttp", "Status %d"), ("linkPage", "A page, not a file")], "code string, message string")
    kind = F.floor("value") % 4
    rows = events(spark, sf).withColumn("code", F.when(kind == 0, "linkMissing").when(kind == 1, "linkPrivate").when(kind == 2, "linkHttp").otherwise("linkPage"))
    return rows.join(F.broadcast(texts), "code").select("event_id", F.replace("message", F.lit("%d"), F.floor("value").cast("string")).alias("message"))


@query("s10_download_problems", f"with {EVENTS}, s as (select event_id, 200 + cast(floor(value) as int) % 5 * 101 as status, tag = 'view' as html from ev) select event_id, case when status = 404 then 'linkMissing' when status in (401, 403) then 'linkPrivate' when status not between 200 and 299 then 'linkHttp' when html then 'linkPage' end as problem from s")
def download_problems(spark, sf):
    status = 200 + F.floor("value").cast("int") % 5 * 101
    problem = F.when(status == 404, "linkMissing").when(status.isin(401, 403), "linkPrivate").when(~status.between(200, 299), "linkHttp").when(F.col("tag") == "view", "linkPage")
    return events(spark, sf).select("event_id", problem.alias("problem"))


@query("a18_download_fraction", f"with {EVENTS} select key, {micro_sql(f'least(sum(cast(floor(value) as bigint)) / {D(100)} / count(*), 1)')} as share from ev group by key")
def download_fraction(spark, sf):
    share = F.least(F.sum(F.floor("value")) / 100.0 / F.count("*"), F.lit(1.0))
    return events(spark, sf).groupBy("key").agg(micro(share).alias("share"))


@query("a16_streaks", f"{WITH}, a as (select page_id, count(*) as n, cast(sum(cast(floor(cos({D(2)} * (x % 180) * pi() / 180) * 1000000 + {D(0.5)}) as bigint)) as double) as c, cast(sum(cast(floor(sin({D(2)} * (x % 180) * pi() / 180) * 1000000 + {D(0.5)}) as bigint)) as double) as s from det group by page_id) select page_id, n, case when n < 6 then 0 else cast(floor(sqrt(c * c + s * s) / 1000000 / n * least(n / {D(40)}, 1) * 10000 + {D(0.5)}) as bigint) end as streaks from a")
def streaks(spark, sf):
    """How far lines agree in direction: the mean vector of doubled angles."""
    angle = F.lit(2.0) * (F.col("x") % 180) * F.pi() / 180
    whole = lambda c: F.sum(F.floor(c * 1000000 + 0.5)).cast("double")
    rows = detections(spark, sf).groupBy("page_id").agg(F.count("*").alias("n"), whole(F.cos(angle)).alias("c"), whole(F.sin(angle)).alias("s"))
    length = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / 1000000 / F.col("n") * F.least(F.col("n") / 40.0, F.lit(1.0))
    return rows.select("page_id", "n", F.when(F.col("n") < 6, F.lit(0)).otherwise(F.floor(length * 10000 + 0.5)).alias("streaks"))


@query("a22_centroid", f"{WITH} select page_id, det_id, {micro_sql(f'x + w / {D(2)}')} as cx, {micro_sql(f'y + h / {D(2)}')} as cy from det where cls = 'balloon'")
def centroid(spark, sf):
    rows = detections(spark, sf, "balloon").select("page_id", "det_id", g.centroid(g.Box.of().polygon()).alias("c"))
    return rows.select("page_id", "det_id", micro(F.col("c.x")).alias("cx"), micro(F.col("c.y")).alias("cy"))


@query("m2_bounds", f"{WITH} select page_id, det_id, {D('x')} as x, {D('y')} as y, {D('w')} as w, {D('h')} as h from det where cls = 'text'")
def bounds(spark, sf):
    return detections(spark, sf, "text").select("page_id", "det_id", g.bounds(g.Box.of().polygon()).alias("b")).select("page_id", "det_id", "b.x", "b.y", "b.w", "b.h")


@query("j3_shape_overlap", f"{WITH} select a.page_id, a.det_id as a_id, b.det_id as b_id, {micro_sql(f'{overlap_sql("a", "b")} / cast(least(a.w * a.h, b.w * b.h) as double)')} as share from det a join det b on b.page_id = a.page_id and a.det_id < b.det_id where a.cls = 'frame' and b.cls = 'frame' and {overlap_sql('a', 'b')} / cast(least(a.w * a.h, b.w * b.h) as double) >= {D(0.5)}")
def shape_overlap(spark, sf):
    frames = detections(spark, sf, "frame")
    smaller = F.least(F.expr("a.w * a.h"), F.expr("b.w * b.h"))
    pairs = overlaps(frames, frames).where("a.det_id < b.det_id").withColumn("share", F.col("inter") / smaller).where("share >= 0.5D")
    return pairs.select("page_id", F.col("a.det_id").alias("a_id"), F.col("b.det_id").alias("b_id"), micro(F.col("share")).alias("share"))


@query("j12_zone_shapes", f"{WITH}, p as (select z.page_id, z.det_id as zone_id, c.det_id as shape_id, row_number() over (partition by z.page_id, z.det_id order by c.conf desc, c.det_id) as n from det z join det c on c.page_id = z.page_id and c.cls = 'frame' where z.cls = 'text' and ({overlap_sql('z', 'c')} / cast(z.w * z.h as double) >= {D(0.8)} or {overlap_sql('z', 'c')} / cast(c.w * c.h as double) >= {D(0.8)} and {overlap_sql('z', 'c')} / cast(z.w * z.h as double) >= {D(0.6)})) select page_id, zone_id, shape_id from p where n = 1")
def zone_shapes(spark, sf):
    zones, shapes = detections(spark, sf, "text"), detections(spark, sf, "frame")
    held, covers = F.col("inter") / F.expr("a.w * a.h"), F.col("inter") / F.expr("b.w * b.h")
    fitting = overlaps(zones, shapes).where((held >= 0.8) | (covers >= 0.8) & (held >= 0.6))
    best = F.row_number().over(Window.partitionBy("page_id", "a.det_id").orderBy(F.desc("b.conf"), "b.det_id"))
    return fitting.withColumn("n", best).where("n = 1").select("page_id", F.col("a.det_id").alias("zone_id"), F.col("b.det_id").alias("shape_id"))


@query("j14_reactions_of_frames", f"with {EVENTS} select ev.event_id, c.conv_id, c.turn from ev join conversations c on c.conv_id = ev.key and c.turn = ev.event_id % 5")
def reactions_of_frames(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    rows = events(spark, sf).select("event_id", F.col("key").alias("conv_id"), (F.col("event_id") % 5).alias("turn"))
    return rows.join(turns, ["conv_id", "turn"]).select("event_id", "conv_id", "turn")


@query("j16_pan_stops", f"{WITH} select f.page_id, f.det_id, count(*) as stops, {micro_sql(f'max(least(1, greatest(0, (f.x + f.w - b.x - b.w / {D(2)}) / f.w)))')} as last_stop from det f join det b on b.page_id = f.page_id and b.cls = 'balloon' and {overlap_sql('b', 'f')} > 0 where f.cls = 'frame' group by 1, 2")
def pan_stops(spark, sf):
    """Where a pan from the right stops for the balloons of its panel."""
    pairs = overlaps(detections(spark, sf, "frame"), detections(spark, sf, "balloon"))
    at = F.expr("(a.x + a.w - b.x - b.w / 2.0D) / a.w")
    return pairs.groupBy("page_id", F.col("a.det_id").alias("det_id")).agg(F.count("*").alias("stops"), micro(F.max(F.least(F.lit(1.0), F.greatest(F.lit(0.0), at)))).alias("last_stop"))


@query("o6_first_pages", "select conv_id, turn from conversations where turn < 3")
def first_pages(spark, sf):
    return table(spark, sf, "conversations").where("turn < 3").select("conv_id", "turn")


@query("o10_middle_page", "with r as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as place, count(*) over (partition by conv_id) as n from conversations) select conv_id, turn from r where place = n // 2")
def middle_page(spark, sf):
    page = Window.partitionBy("conv_id")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", (F.row_number().over(page.orderBy("turn")) - 1).alias("place"), F.count("*").over(page).alias("n"))
    return rows.where(F.col("place") == F.floor(F.col("n") / 2)).select("conv_id", "turn")


@query("o7_sorted_reactions", f"with {EVENTS} select key, event_id, row_number() over (partition by key order by tag, t) as place from ev")
def sorted_reactions(spark, sf):
    return events(spark, sf).select("key", "event_id", F.row_number().over(Window.partitionBy("key").orderBy("tag", "t")).cast("long").alias("place"))


@query("m31_notes", f"with {EVENTS}, n as (select key, event_id, t, cast(floor(value) as int) % 60 + 30 as midi, event_id % 12 = 9 as drum from ev) select key, event_id, t, drum, cast(floor(440 * pow({D(2)}, (midi - 69) / {D(12)}) * 1000 + {D(0.5)}) as bigint) as millihertz from n")
def notes(spark, sf):
    midi = F.floor("value").cast("int") % 60 + 30
    return events(spark, sf).select("key", "event_id", "t", (F.col("event_id") % 12 == 9).alias("drum"), F.floor(cam.note_frequency(midi) * 1000 + 0.5).alias("millihertz"))


@query("m30_note_schedule", f"with {EVENTS}, s as (select *, t // 3600000000 as pass from ev), r as (select *, row_number() over (partition by key, pass order by t, event_id) as n from s) select key, pass, event_id from r where n <= 24")
def note_schedule(spark, sf):
    """At most 24 notes a pass, the earliest first."""
    rows = events(spark, sf).withColumn("pass", F.floor(F.col("t") / 3_600_000_000))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("key", "pass").orderBy("t", "event_id"))).where("n <= 24").select("key", "pass", "event_id")


@query("t10_rounding", f"with {EVENTS} select event_id, cast(floor(value * 10 + {D(0.5)}) as bigint) as half_up, cast(trunc(value) as bigint) as cut from ev")
def rounding(spark, sf):
    return events(spark, sf).select("event_id", F.floor(F.col("value") * 10 + 0.5).alias("half_up"), F.col("value").cast("long").alias("cut"))


@query("t12_last_wins", f"with {EVENTS} select key, tag, max_by(event_id, t) as event_id from ev group by key, tag")
def last_wins(spark, sf):
    """Maps built from entries in order: the last value of a key stays."""
    return events(spark, sf).groupBy("key", "tag").agg(F.max_by("event_id", "t").alias("event_id"))


@query("r22_pending_resume", "select conv_id, min(turn) as frame from conversations where turn % 3 = 2 group by conv_id")
def pending_resume(spark, sf):
    return table(spark, sf, "conversations").where("turn % 3 = 2").groupBy("conv_id").agg(F.min("turn").alias("frame"))


@query("r11_resume", "with done as (select distinct o_custkey, o_orderkey % 40 as place from orders where o_orderstatus = 'F') select distinct o_custkey, o_orderkey % 40 as place from orders o where not exists (select 1 from done d where d.o_custkey = o.o_custkey and d.place = o.o_orderkey % 40)")
def resume(spark, sf):
    """Pages that a run which starts again still has to do."""
    pages = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 40).alias("place"), "o_orderstatus")
    done = pages.where("o_orderstatus = 'F'").select("o_custkey", "place").distinct()
    return pages.select("o_custkey", "place").distinct().join(done, ["o_custkey", "place"], "left_anti")


@query("r13_retained_pages", f"with {EVENTS}, s as (select key, event_id, t, cast(floor(value) as bigint) % 40 as page, row_number() over (partition by key order by t) as i from ev), l as (select key, max_by(page, i) as cur from s group by key) select s.key, s.event_id from s join l on l.key = s.key where s.page between cur - 2 and cur + 5")
def retained_pages(spark, sf):
    rows = events(spark, sf).withColumn("page", F.floor("value") % 40)
    cursor = rows.groupBy("key").agg(F.max_by("page", "t").alias("cur"))
    return rows.join(cursor, "key").where(F.col("page").between(F.col("cur") - 2, F.col("cur") + 5)).select("key", "event_id")


SIZES = (1280, 960, 640)


@query("w7_slow_down", f"with recursive {EVENTS}, s as (select key, row_number() over (partition by key order by t) as i, value > 50 as slow from ev), walk as (select key, cast(0 as bigint) as i, 0 as step, 0 as slow_runs from (select distinct key from s) union all select w.key, s.i, case when s.slow and w.step < 2 and w.slow_runs = 1 then w.step + 1 else w.step end, case when w.step >= 2 then w.slow_runs when s.slow then case when w.slow_runs = 1 then 0 else w.slow_runs + 1 end else w.slow_runs end from walk w join s on s.key = w.key and s.i = w.i + 1), e as (select *, row_number() over (partition by key order by i desc) as n from walk) select key, case step when 0 then 1280 when 1 then 960 else 640 end as size from e where n = 1")
def slow_down(spark, sf):
    """Two slow runs at a size step down to the next one; the last size stays."""
    step = F.least(F.floor(F.count_if(F.col("value") > 50) / 2), F.lit(len(SIZES) - 1)).cast("int")
    return events(spark, sf).groupBy("key").agg(step.alias("step")).select("key", F.get(F.array(*(F.lit(s) for s in SIZES)), F.col("step")).alias("size"))
