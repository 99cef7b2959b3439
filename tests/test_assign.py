"""Which panels own a box: cases by outline, overlap, focus and tail."""

from gutterline.operators import assign


def rectangle(x, y, w, h):
    return [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]


def owners(spark, *cases):
    """(owners, rules) of each case: box, panels of (conf, x, y, w, h) and maybe an outline, focus, tail."""
    point = lambda p: None if p is None else (float(p[0]), float(p[1]))
    cases = [(*c, None, None)[:4] for c in cases]
    boxes = spark.createDataFrame([(n, 0, *box, point(focus), point(tail), "own") for n, (box, _, focus, tail) in enumerate(cases)], "page_id long, det_id long, x long, y long, w long, h long, focus struct<x: double, y: double>, tail struct<x: double, y: double>, rule string")
    rows = [(n, k, float(p[0]), *p[1:5], p[5] if len(p) > 5 else rectangle(*p[1:5])) for n, (_, panels, _, _) in enumerate(cases) for k, p in enumerate(panels)]
    frames = spark.createDataFrame(rows, "page_id long, det_id long, conf double, x long, y long, w long, h long, polygon array<struct<x: double, y: double>>")
    found, plain = ([(r.page_id, r.panel_id, r.rule) for r in assign.owners(boxes, f).orderBy("page_id", "panel_id").collect()] for f in (frames, frames.drop("polygon")))
    boxed = {n for n, (_, panels, _, _) in enumerate(cases) if all(len(p) < 6 for p in panels)}
    assert [r for r in found if r[0] in boxed] == [r for r in plain if r[0] in boxed]  # boxes are their own outlines
    return [([k for p, k, _ in found if p == n], {rule for p, _, rule in found if p == n}) for n in range(len(cases))]


LEFT_OUTLINE = [(200.0, 0.0), (480.0, 0.0), (480.0, 300.0), (200.0, 300.0)]


CASES = [
    ((100, 100, 80, 60), [(0.9, 500, 0, 500, 1400), (0.9, 0, 0, 480, 300)], [1], "whole"),
    ((120, 100, 70, 60), [(0.95, 500, 0, 500, 1400), (0.8, 150, 0, 330, 300, LEFT_OUTLINE)], [1], "box"),
    ((320, 100, 40, 40), [(0.95, 600, 0, 400, 1400), (0.8, 0, 0, 300, 300)], [1], "nearest"),
    ((500, 1000, 80, 90), [(0.95, 0, 900, 700, 700), (0, 480, 0, 1500, 1600)], [0], "whole"),
    ((440, 100, 120, 60), [(0.9, 0, 0, 500, 700), (0.9, 500, 0, 500, 700)], [0, 1], "shared"),
    ((343, 304, 188, 243), [(0.96, 60, 300, 470, 280), (0, 430, 0, 600, 1300)], [0], "whole"),
    ((0, 0, 100, 100), [(0.01, 50, 0, 10, 100), (0.01, 0, 0, 10, 100)], [0], "box"),
]


def test_by_outline_and_box(spark):
    assert owners(spark, *(c[:2] for c in CASES)) == [(c[2], {c[3]}) for c in CASES]


PAIR = [(0.88, 494, 5, 610, 1070), (0.97, 91, 96, 388, 493)]


def test_focus_decides_among_sharers(spark):
    box = (377, 60, 196, 256)
    assert owners(spark, (box, PAIR), (box, PAIR, (399, 309)), (box, PAIR, (10, 10))) == [([0, 1], {"shared"}), ([1], {"focus"}), ([0, 1], {"shared"})]


def test_tail_decides_first(spark):
    """The box lies wholly in the upper panel; its tail points at the lower one, which it touches."""
    panels = [(0.9, 0, 0, 500, 300), (0.9, 0, 290, 500, 300)]
    box, tail = (100, 100, 100, 195), (150, 320)
    untouched, two = (100, 100, 100, 100), [*panels, (0.5, 0, 290, 500, 300)]
    found = owners(spark, (box, panels), (box, panels, None, tail), (untouched, panels, None, tail), (box, two, None, tail))
    assert found == [([0], {"whole"}), ([1], {"tail"}), ([0], {"whole"}), ([0], {"whole"})]


def test_nothing_to_own(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 0, 5, 5), (2, 0, 0, 0, 0, 0)], "page_id long, det_id long, x long, y long, w long, h long")
    frames = spark.createDataFrame([(2, 7, 0.5, 0, 0, 9, 9)], "page_id long, det_id long, conf double, x long, y long, w long, h long")
    assert [tuple(r) for r in assign.owners(boxes, frames).collect()] == [(2, 0, 7, "whole")]
    assert assign.owners(boxes, frames.where("false")).count() == 0
    assert assign.owners(boxes.where("false"), frames).count() == 0


def test_framing_deals_rows_by_page_alone(spark, sf):
    """Once dealt by page, boxes and panels meet where they lie."""
    from gutterline.plans import layout_queries  # noqa: F401
    from gutterline.plans.registry import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["p6_framed"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert dealt and not any("box_id" in line or "panel_id" in line for line in dealt)
