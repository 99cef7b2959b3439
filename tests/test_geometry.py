import math

from pyspark.sql import functions as F

from gutterline.functions import geometry as g


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def polygon(*points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


def test_polygons(spark):
    square, none = polygon((0, 0), (4, 0), (4, 2), (0, 2)), polygon((0, 0)).cast("array<struct<x:double,y:double>>")
    row = one(
        spark, area=g.polygon_area(square), round=g.perimeter(square), nothing=g.polygon_area(F.slice(none, 1, 0)), point=g.polygon_area(none), jag=g.jaggedness(square), flat=g.jaggedness(none), tilt=g.tilt(square),
        diamond=g.tilt(polygon((5, 0), (10, 5), (5, 10), (0, 5))), box=g.bounds(square), middle=g.centroid(square),
    )
    assert (row.area, row.round, row.nothing, row.point, row.flat, row.tilt) == (8.0, 12.0, 0.0, 0.0, 1.0, 0.0)
    assert math.isclose(row.jag, 144 / (4 * math.pi * 8)) and math.isclose(row.diamond, 1.0)
    assert tuple(row.box) == (0.0, 0.0, 4.0, 2.0) and tuple(row.middle) == (2.0, 1.0)


def test_point_in_polygon_is_half_open(spark):
    square = polygon((0, 0), (4, 0), (4, 4), (0, 4))
    at = lambda x, y: g.contains(square, F.lit(float(x)), F.lit(float(y)))
    row = one(spark, inside=at(2, 2), left=at(0, 2), right=at(4, 2), top=at(2, 0), bottom=at(2, 4), out=at(9, 2))
    assert (row.inside, row.left, row.right, row.top, row.bottom, row.out) == (True, True, False, True, False, False)


def test_clip(spark):
    triangle = polygon((0, 0), (4, 0), (0, 4))
    row = one(spark, low=g.polygon_area(g.clip(triangle, "x", F.lit(2.0), True)), high=g.polygon_area(g.clip(triangle, "x", F.lit(2.0), False)), all=g.polygon_area(g.clip(triangle, "y", F.lit(9.0), True)))
    assert (row.low, row.high, row.all) == (6.0, 2.0, 8.0)


def test_boxes(spark):
    box = lambda x, y, w, h: g.Box(*(F.lit(v) for v in (x, y, w, h)))
    a, b = box(0, 0, 10, 10), box(5, 5, 10, 10)
    row = one(spark, inter=a.intersection(b), iou=a.iou(b), apart=a.intersection(box(20, 0, 5, 5)), share=b.share_inside(a), none=box(0, 0, 0, 0).iou(box(0, 0, 0, 0)))
    assert (row.inter, row.apart, row.share, row.none) == (25, 0, 0.25, 0.0) and math.isclose(row.iou, 25 / 175)


def test_tension(spark):
    row = one(spark, calm=g.tension(F.lit(0.0), F.lit(1.0), F.lit(0.0)), most=g.tension(F.lit(9.0), F.lit(9.0), F.lit(9.0)))
    assert (row.calm, row.most) == (0.0, 1.0)


def test_a_polygon_is_computed_once(spark):
    """However often a fold names its polygon, the plan holds the expression that makes it once."""
    rows = spark.range(3).select(F.array(*(F.struct((F.col("id") + x).cast("double").alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (9, 0), (9, 5), (0, 5)))).alias("p"))
    cut = lambda lower: g.clip(F.reverse("p"), "x", F.lit(6.0), lower)
    for column, value in ((g.polygon_area(cut(True)), 30.0), (g.perimeter(cut(False)), 16.0), (g.samples_in_polygon(cut(True), g.Box(F.lit(0), F.lit(0), F.lit(12), F.lit(12))), 9)):
        found = rows.select(column.alias("v"))
        assert found._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1
        assert found.first().v == value


def test_samples_in_a_polygon_are_those_that_contain_says(spark):
    shapes = [[(0, 0), (10, 2), (7, 9), (3, 4), (1, 8)], [(0, 0), (6, 6), (6, 0), (0, 6)], [(2, 2)], [], None, [(0, 0), None, (5, 9)]]
    rows = spark.createDataFrame([(s and [q and dict(zip("xy", map(float, q))) for q in s],) for s in shapes], "p array<struct<x: double, y: double>>")
    box = g.Box(F.lit(1), F.lit(1), F.lit(5), F.lit(7))
    places = [g.contains(F.col("p"), F.lit(1 + 5.0 * i / 5), F.lit(1 + 7.0 * j / 5)).cast("int") for i in range(6) for j in range(6)]
    for r in rows.select(g.samples_in_polygon(F.col("p"), box).alias("ours"), sum(F.coalesce(c, F.lit(0)) for c in places).alias("theirs")).collect():
        assert r.ours == r.theirs
