import numpy as np
import pytest
from pyspark.sql import functions as F

from gutterline.operators import decode, lift, orphans, outlines, page_rasters, raster, timeline


def rectangle(x, y, w, h):
    return np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)


def test_polygon_iou():
    box = rectangle(0, 0, 80, 80)
    assert outlines.polygon_iou(box, box) == 1
    assert outlines.polygon_iou(box, rectangle(40, 0, 80, 80)) == pytest.approx(1 / 3)
    assert outlines.polygon_iou(box, rectangle(200, 200, 80, 80)) == 0
    triangle = np.array([[0, 0], [800, 0], [0, 800]], float)
    assert outlines.polygon_iou(rectangle(0, 0, 800, 800), triangle) == pytest.approx(0.5, abs=0.01)


def test_tail_tip():
    spike = np.array([[10, 10], [90, 10], [90, 70], [55, 70], [62, 99], [45, 70], [10, 70]], float)
    x, y = outlines.tail_tip(spike)
    assert abs(x - 62) <= 2 and 94 <= y <= 98  # the last cells of so thin a spike touch at corners only
    assert outlines.tail_tip(rectangle(0, 0, 60, 40)) is None
    assert outlines.tail_tip(rectangle(0, 0, 1, 1)) is None and outlines.tail_tip(spike[:2]) is None


def test_opening_keeps_corners_and_drops_lines():
    mask = np.zeros((20, 20), bool)
    mask[4:14, 4:14] = mask[8, 14:18] = True
    out = outlines.opened_by_square(mask, 2)
    assert out[4:14, 4:14].all() and out.sum() == 100


def test_tips_of_a_table(spark):
    point = "array<struct<x:double,y:double>>"
    rows = spark.createDataFrame([(1, 1, [(0.0, 0.0), (60.0, 0.0), (60.0, 40.0), (0.0, 40.0)]), (1, 2, [])], f"page_id long, det_id long, polygon {point}")
    assert [(r.tip_x, r.tip_y) for r in outlines.tail_tips(rows).collect()] == [(None, None)] * 2


def test_orphans(spark):
    mask = np.zeros((8, 8), int)
    mask[0:3, 0:3] = mask[4:8, 4:8] = 1
    masks = spark.createDataFrame([(1, mask.ravel().tolist()), (2, [0] * 64)], "page_id long, mask array<int>")
    panels = spark.createDataFrame([(1, 1, "frame", 0, 0, 3, 3, 0.9)], "page_id long, det_id long, cls string, x long, y long, w long, h long, conf double")
    rows = orphans.orphans(masks, panels).collect()
    assert [(r.page_id, r.x, r.y, r.w, r.h, r.area) for r in rows] == [(1, 4, 4, 4, 4, 16)]
    assert orphans.orphans(masks, panels.where("false")).count() == 2  # both squares


def test_decoding_of_odd_output(spark):
    rows = spark.createDataFrame([(1, [], [], []), (2, None, None, None), (3, [1, 0, 2], [float(v) for v in (0, 0, 100, 50, 1, 1, 2, 2, 990, 1490, 1000, 1500)], [0.9, 0.9, 0.01])], "page_id long, labels array<long>, boxes array<double>, scores array<double>")
    found = decode.decoded_text(rows, 1000, 1500, 0.05).collect()
    assert [(r.page_id, r.place, r.free, r.x, r.y, r.w, r.h) for r in found] == [(3, 0, False, 0.0, 0.0, 108.0, 54.0)]
    none = spark.createDataFrame([], "id long, coefficients array<double>, x1 int, y1 int, x2 int, y2 int")
    assert decode.decoded_masks(none, np.zeros((2, 4, 4))).count() == 0


def test_lift_and_resize(spark):
    flat = spark.range(1).select(F.array_repeat(F.lit(100), 64).alias("m"))
    row = flat.select(lift.ink_by_light(F.col("m")).alias("light"), lift.ink_by_color(F.col("m"), F.col("m"), F.col("m"), 8).alias("color"), raster.bilinear(F.col("m"), 8, 12).alias("more")).first()
    assert row.light is None and set(row.color) == {0} and row.more == [100] * 144


def test_pan_waits_for_its_stop(spark):
    ticks = spark.createDataFrame([(1, t, t, 100, int(t >= 6)) for t in range(12)], "key long, t long, event_id long, dt long, revealed long")
    places = [r.place for r in timeline.pan_progress(ticks, [300], 1000, 100, end=1000).orderBy("t").collect()]
    assert places == [0, 100, 200, 300, 300, 300, 400, 500, 600, 700, 800, 900]


def plain_tip(points):
    """The tip by window sums and a walk cell by cell."""
    (x0, y0), (x1, y1) = np.floor(points.min(0)).astype(int) - outlines.MARGIN, np.ceil(points.max(0)).astype(int) + outlines.MARGIN + 1
    if min(x1 - x0, y1 - y0) < outlines.LEAST_SIDE:
        return None
    mask, r = outlines.covered(points, x0, y0, x1 - x0, y1 - y0), max(2, int(np.floor(min(x1 - x0, y1 - y0) * outlines.TAIL_WIDTH + 0.5)))
    body = outlines.window_sums(outlines.window_sums(mask, r) == (2 * r + 1) ** 2, r) > 0
    steps, furthest = page_rasters.walked(mask & ~body, body)
    return None if furthest < 0 else (furthest % (x1 - x0) + x0, furthest // (x1 - x0) + y0)


def test_tips_by_whole_numbers_are_those_cell_by_cell(spark):
    rng, shapes = np.random.default_rng(5), []
    for n in range(120):
        w, h = rng.integers(12, 90, 2)
        outline = rectangle(*(rng.integers(-40, 400, 2) / 4), w, h)
        spike = outline[2] - [[w * a, b] for a, b in ((0.4, 0), (rng.random(), -int(rng.integers(0, 40))), (0.6, 0))]
        shapes.append(np.concatenate([outline[:3], spike, outline[3:]]) if n % 5 else rng.integers(0, 60, (n % 7 + 3, 2)).astype(float))
    tips = [plain_tip(p) for p in shapes]
    assert [outlines.tail_tip(p) for p in shapes] == tips and 20 < tips.count(None) < 100
    point = "array<struct<x:double,y:double>>"
    rows = spark.createDataFrame([(1, n, [tuple(v) for v in p.tolist()]) for n, p in enumerate(shapes)] + [(2, 1, None)], f"page_id int, det_id int, polygon {point}")
    found = {(r.page_id, r.det_id): (r.tip_x, r.tip_y) for r in outlines.tail_tips(rows).collect()}
    assert found == {(1, n): tip or (None, None) for n, tip in enumerate(tips)} | {(2, 1): (None, None)}


def test_outlines_that_differ_by_place_are_walked_once(spark):
    rng, spike = np.random.default_rng(7), np.array([[10, 10], [90, 10], [90, 70], [55, 70], [62, 99], [45, 70], [10, 70]], float)
    places = [(0.0, 0.0), (-40.0, 7.0), *((float(x), float(y)) for x, y in rng.integers(-50, 5000, (20, 2)))]
    assert {tuple(np.subtract(outlines.tail_tip(spike + p), p)) for p in places} == {outlines.tail_tip(spike)}
    point = "array<struct<x:double,y:double>>"
    rows = spark.createDataFrame([(n, 1, [tuple(v) for v in (spike + p).tolist()]) for n, p in enumerate([*places, (0.5, 0.0)])], f"page_id long, det_id long, polygon {point}")
    assert rows.select(outlines.shape_key(F.col("polygon"))).distinct().count() == 2
    tips = {r.page_id: (r.tip_x, r.tip_y) for r in outlines.tail_tips(rows.coalesce(1)).collect()}
    assert all(tips[n] == outlines.tail_tip(spike + p) for n, p in enumerate([*places, (0.5, 0.0)]))
