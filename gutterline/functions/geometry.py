"""Boxes and polygons as columns.

A box is four columns or fields x, y, w, h; a polygon is an array of structs
of x and y.  Everything stays inside Catalyst: polygons are folded with
higher-order functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box:
    """Four columns that form a box."""

    def __init__(self, x: Column, y: Column, w: Column, h: Column) -> None:
        self.x, self.y, self.w, self.h = x, y, w, h

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        """From columns of a row, or of an alias or struct ``prefix``."""
        return cls(*(F.col(f"{prefix}.{c}" if prefix else c) for c in "xywh"))

    @classmethod
    def field(cls, value: Column) -> Box:
        return cls(*(value[c] for c in "xywh"))

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h

    def intersection(self, other: Box) -> Column:
        across = F.least(self.right, other.right) - F.greatest(self.x, other.x)
        down = F.least(self.bottom, other.bottom) - F.greatest(self.y, other.y)
        return F.greatest(across, F.lit(0)) * F.greatest(down, F.lit(0))

    def iou(self, other: Box) -> Column:
        shared = self.intersection(other)
        union = self.area + other.area - shared
        return F.when(union > 0, shared / union).otherwise(F.lit(0.0))

    def share_inside(self, outer: Box) -> Column:
        """How much of this box lies in ``outer``; a box without area counts as one pixel."""
        return self.intersection(outer) / F.greatest(self.area, F.lit(1))

    def polygon(self) -> Column:
        """The corners, clockwise from the top left."""
        corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
        return F.array(corner(self.x, self.y), corner(self.right, self.y), corner(self.right, self.bottom), corner(self.x, self.bottom))


def _once(value: Column, of) -> Column:
    """``of(value)``, with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _sides(polygon: Column, term) -> Column:
    """``term(from, to)`` of each edge, as an array; ``polygon`` is named three times."""
    return F.zip_with(polygon, F.concat(F.slice(polygon, F.lit(2), F.size(polygon)), F.slice(polygon, 1, 1)), term)


def _edges(polygon: Column, term) -> Column:
    """Sum of ``term(from, to)`` over the edges; 0 for no points."""
    return _once(polygon, lambda p: F.aggregate(_sides(p, term), F.lit(0.0), lambda a, x: a + x))


def polygon_area(polygon: Column) -> Column:
    return F.abs(_edges(polygon, lambda a, b: a.x * b.y - b.x * a.y)) / 2


def perimeter(polygon: Column) -> Column:
    return _edges(polygon, lambda a, b: F.hypot(b.x - a.x, b.y - a.y))


def jaggedness(polygon: Column) -> Column:
    """Perimeter squared over that of a circle of the same area; 1 without an area."""
    area = polygon_area(polygon)
    round_ = perimeter(polygon)
    return F.when((F.size(polygon) >= 3) & (area > 0), round_ * round_ / (F.lit(4 * math.pi) * area)).otherwise(F.lit(1.0))


def tilt(polygon: Column) -> Column:
    """Length-weighted share of edges off the axes: 0 upright, 1 at 45 degrees."""
    quarter = math.pi / 2

    def length(a: Column, b: Column) -> Column:
        n = F.hypot(b.x - a.x, b.y - a.y)
        return F.when(n < 1, F.lit(0.0)).otherwise(n)

    def off(a: Column, b: Column) -> Column:
        turn = F.abs(F.atan2(b.y - a.y, b.x - a.x)) % F.lit(quarter)
        return F.least(turn, F.lit(quarter) - turn) / F.lit(quarter / 2) * length(a, b)

    total = _edges(polygon, length)
    return F.when(total > 0, _edges(polygon, off) / total).otherwise(F.lit(0.0))


def bounds(polygon: Column) -> Column:
    """The bounding box of a polygon as a struct of x, y, w, h."""
    xs, ys = F.transform(polygon, lambda p: p.x), F.transform(polygon, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def centroid(polygon: Column) -> Column:
    n = F.greatest(F.size(polygon), F.lit(1))
    total = lambda axis: F.aggregate(F.transform(polygon, lambda p: p[axis]), F.lit(0.0), lambda a, v: a + v) / n
    return F.struct(total("x").alias("x"), total("y").alias("y"))


def contains(polygon: Column, x: Column, y: Column) -> Column:
    """Ray crossing; an edge counts for heights from its lower end up to, but
    without, its upper end."""
    crossing = lambda a, b: F.when((a.y > y) != (b.y > y), F.when(x < (b.x - a.x) * (y - a.y) / (b.y - a.y) + a.x, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))
    return (_edges(polygon, crossing) % 2) == 1


def clip(polygon: Column, axis: str, at: Column, keep_lower: bool) -> Column:
    """The part of a polygon on one side of a line across ``axis``."""
    inside = (lambda p: p[axis] <= at) if keep_lower else (lambda p: p[axis] >= at)

    def edge(a: Column, b: Column) -> Column:
        share = (at - a[axis]) / F.nullif(b[axis] - a[axis], F.lit(0.0))
        cut = F.struct((a.x + share * (b.x - a.x)).alias("x"), (a.y + share * (b.y - a.y)).alias("y"))
        return F.array(F.when(inside(a), a), F.when((inside(a) != inside(b)) & share.isNotNull(), cut))

    return _once(polygon, lambda p: F.array_compact(F.flatten(_sides(p, edge))))


def samples_inside(outer: Box, inner: Box, per_side: int = 6) -> Column:
    """How many of a grid of points over ``inner``, edges included, lie in the
    rectangle ``outer`` by the rule of ``contains``: its left and top edges
    belong to it, its right and bottom ones don't."""
    place = lambda start, size, k: start.cast("double") + size.cast("double") * k / (per_side - 1)
    count = lambda start, size, low, high: sum(F.when((place(start, size, k) >= low) & (place(start, size, k) < high), 1).otherwise(0) for k in range(per_side))
    return count(inner.x, inner.w, outer.x, outer.right) * count(inner.y, inner.h, outer.y, outer.bottom)


def samples_in_polygon(polygon: Column, inner: Box, per_side: int = 6) -> Column:
    """How many of a grid of points over ``inner``, edges included, lie in a polygon."""
    step = lambda start, size, k: start.cast("double") + size.cast("double") * F.lit(float(k)) / (per_side - 1)

    def row(p: Column, y: Column) -> Column:
        """Places of a row from which a ray to the right meets the edges an odd number of times."""
        edges = F.filter(_sides(p, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda e: (e.a.y > y) != (e.b.y > y))
        met = F.transform(edges, lambda e: (e.b.x - e.a.x) * (y - e.a.y) / (e.b.y - e.a.y) + e.a.x)
        held = lambda c, k: (F.size(F.filter(c, lambda at: step(inner.x, inner.w, k) < at)) % 2)
        return _once(met, lambda c: sum((held(c, k) for k in range(1, per_side)), held(c, 0)))

    heights = F.array(*(step(inner.y, inner.h, k) for k in range(per_side)))
    hits = _once(polygon, lambda p: F.aggregate(F.transform(heights, lambda y: row(p, y)), F.lit(0), lambda n, k: n + k))
    return F.coalesce(hits, F.lit(0))


def tension(ink: Column, jagged: Column, tilted: Column) -> Column:
    """0 to 1: half ink, three tenths ragged outline, two tenths tilt."""
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return F.least(F.lit(1.0), 0.5 * unit((ink - 0.12) / 0.4) + 0.3 * unit((jagged - 1.15) / 0.8) + 0.2 * F.least(F.lit(1.0), tilted * 4))
