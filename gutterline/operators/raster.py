"""Masks and small rasters.

Neighbourhood operators on a flat array are higher-order functions; those
that walk (components, floods, contours) are numpy helpers inside
``mapInPandas``, one mask at a time.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 8


def ink_of(values: Column, below: float = -0.1) -> Column:
    """1 where a value is ink, 0 elsewhere."""
    return F.transform(values, lambda v: F.when(v.cast("double") < below, 1).otherwise(0))


def cells(masks: DataFrame, side: int = SIDE) -> DataFrame:
    """(vec_id, mask) to (vec_id, x, y, v)."""
    return masks.select("vec_id", F.posexplode("mask").alias("p", "v")).select("vec_id", (F.col("p") % side).alias("x"), F.floor(F.col("p") / side).cast("int").alias("y"), "v")


def _around(mask: Column, side: int, at, of) -> Column:
    """For each cell, ``of`` the values at its nine places, where ``at(x, y,
    dx, dy)`` gives a place or null."""
    one = lambda p: of([F.get(mask, at(p % side, F.floor(p / side).cast("int"), dx, dy)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), one)


def _inside(side: int):
    return lambda x, y, dx, dy: F.when((x + dx).between(0, side - 1) & (y + dy).between(0, side - 1), (y + dy) * side + x + dx)


def _clamped(side: int):
    edge = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(side - 1))
    return lambda x, y, dx, dy: edge(y + dy) * side + edge(x + dx)


def eroded(mask: Column, side: int = SIDE) -> Column:
    """Ink whose whole 3 x 3 square is ink; outside is background."""
    return _around(mask, side, _inside(side), lambda vs: F.least(*(F.coalesce(v, F.lit(0)) for v in vs)))


def dilated(mask: Column, side: int = SIDE) -> Column:
    return _around(mask, side, _inside(side), lambda vs: F.greatest(*(F.coalesce(v, F.lit(0)) for v in vs)))


def blurred(mask: Column, side: int = SIDE) -> Column:
    """Sum of the 3 x 3 square, edges repeated outwards."""
    return _around(mask, side, _clamped(side), lambda vs: sum(vs[1:], vs[0]))


def bilinear(image: Column, side: int, target: int) -> Column:
    """A square resampled to another size: centres aligned, edges repeated,
    rounded half up."""
    places = [min(max((d + 0.5) * (side / target) - 0.5, 0.0), side - 1.0) for d in range(target)]
    low, high, part = F.lit([int(p) for p in places]), F.lit([min(int(p) + 1, side - 1) for p in places]), F.lit([p - int(p) for p in places])

    def cell(i: Column) -> Column:
        x, y = i % target, F.floor(i / target).cast("int")
        at = lambda rows, columns: F.get(image, F.get(rows, y) * side + F.get(columns, x)).cast("double")
        upper = at(low, low) + (at(low, high) - at(low, low)) * F.get(part, x)
        lower = at(high, low) + (at(high, high) - at(high, low)) * F.get(part, x)
        return F.floor(upper + (lower - upper) * F.get(part, y) + 0.5).cast("long")

    return F.transform(F.sequence(F.lit(0), F.lit(target * target - 1)), cell)


def parts(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, number) of each run of a 0/1 mask's cells in scan order:
    its connected part is numbered from 0, in scan order too."""
    height, width = mask.shape
    wide = width + 2
    padded = np.zeros((height, wide), bool)
    padded[:, 1:-1] = mask
    padded = padded.ravel()
    edges = np.flatnonzero(padded[1:] != padded[:-1])  # starts and ends in turn; none crosses rows
    start, end = edges[::2], edges[1::2]
    touch = 1 if diagonal else 0
    first = np.searchsorted(end, start - (wide + touch), "right")  # runs of the row above that touch a run
    last = np.searchsorted(start, end - (wide - touch))
    runs, count = np.arange(len(start)), last - first
    root = np.where(count > 0, first, runs)
    while True:
        up = root[root]
        if (up == root).all():
            break
        root = up
    joins = np.flatnonzero(count > 1)
    if len(joins):  # further runs above: trees meet, the lesser root stays
        joined = root.tolist()

        def top(run: int) -> int:
            while joined[run] != run:
                joined[run] = run = joined[joined[run]]
            return run

        for low, high in zip(first[joins].tolist(), last[joins].tolist(), strict=True):
            one = top(low)
            for run in range(low + 1, high):
                other = top(run)
                if one != other:
                    one, other = min(one, other), max(one, other)
                    joined[other] = one
        root = np.array(joined)[root]
        while (root[root] != root).any():
            root = root[root]
    number = (root == runs).cumsum()[root] - 1
    row = start // wide
    return row, start - row * wide, end - row * wide, number


def labels(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Connected parts of a 0/1 mask, numbered from 1 in scan order."""
    row, start, end, number = parts(mask != 0, diagonal)
    return painted(mask.shape, row, start, end, number + 1)


def painted(shape: tuple[int, int], row: np.ndarray, start: np.ndarray, end: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The cells of runs with their run's number; 0 elsewhere."""
    out = np.zeros(shape[0] * shape[1] + 1, int)
    np.add.at(out, row * shape[1] + start, number)
    np.subtract.at(out, row * shape[1] + end, number)
    return out[:-1].cumsum().reshape(shape)


def sizes(row: np.ndarray, start: np.ndarray, end: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Areas, left, top, right and bottom cells of the parts that runs have, the first part at 0."""
    count = int(number.max()) + 1 if len(number) else 0
    left, top, right, bottom = np.full(count, int(end.max(initial=0))), np.zeros(count, int), np.full(count, -1), np.zeros(count, int)
    np.minimum.at(left, number, start)
    np.maximum.at(right, number, end - 1)
    top[number[::-1]], bottom[number] = row[::-1], row  # runs lie row by row: the last that is written stays
    return np.bincount(number, end - start, count).astype(int), left, top, right, bottom


def measures(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Areas, left, top, right and bottom cells of labelled parts, the first part at 0."""
    ys, xs = np.nonzero(found)
    part = found[ys, xs] - 1
    count = int(found.max(initial=0))
    left, top, right, bottom = (np.full(count, v) for v in (found.shape[1], found.shape[0], -1, -1))
    for of, side, at in ((np.minimum, left, xs), (np.minimum, top, ys), (np.maximum, right, xs), (np.maximum, bottom, ys)):
        of.at(side, part, at)
    return np.bincount(part, minlength=count), left, top, right, bottom


def components(masks: DataFrame, diagonal: bool = True, side: int = SIDE) -> DataFrame:
    """(vec_id, mask) to a row for each component: label, area, bounding box."""

    def measure(batches):
        for batch in batches:
            rows = []
            for vec_id, mask in zip(batch["vec_id"], batch["mask"], strict=True):
                parts = measures(labels(np.asarray(mask).reshape(side, side), diagonal))
                for label, (area, left, top, right, bottom) in enumerate(zip(*parts, strict=True), 1):
                    rows.append((vec_id, label, area, left, top, right - left + 1, bottom - top + 1))
            yield pd.DataFrame(rows, columns=["vec_id", "label", "area", "x", "y", "w", "h"])

    return masks.select("vec_id", "mask").mapInPandas(measure, "vec_id long, label long, area long, x long, y long, w long, h long")


def distances(free: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Steps from the nearest seed through free cells, 4-connected; -1 if out of reach."""
    out = np.where(seeds & free, 0, -1)
    queue = deque(zip(*np.nonzero(out == 0), strict=True))
    while queue:
        y, x = queue.popleft()
        for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= v < free.shape[0] and 0 <= u < free.shape[1] and free[v, u] and out[v, u] < 0:
                out[v, u] = out[y, x] + 1
                queue.append((v, u))
    return out


def outside(mask: np.ndarray) -> np.ndarray:
    """Background that is connected to the border."""
    border = np.zeros(mask.shape, bool)
    border[[0, -1], :] = border[:, [0, -1]] = True
    return distances(mask == 0, border) >= 0


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes."""
    return ~outside(mask)


def contour(mask: np.ndarray) -> list[tuple[int, int]]:
    """Outline of the first component, clockwise from its first cell in scan
    order, by walking with a hand on the outside."""
    if not mask.any():
        return []
    ys, xs = np.nonzero(mask)
    start = (int(xs[0]), int(ys[0]))
    ring = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    ink = lambda x, y: 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and bool(mask[y, x])
    out, at, came = [start], start, 4
    first_move = None
    for _ in range(4 * mask.size + 8):
        for turn in range(1, 9):
            way = (came + turn) % 8
            step = (at[0] + ring[way][0], at[1] + ring[way][1])
            if ink(*step):
                break
        else:
            return out
        if at == start and first_move is not None and way == first_move:
            return out[:-1] if out[-1] == start and len(out) > 1 else out
        if first_move is None:
            first_move = way
        at, came = step, (way + 4) % 8
        out.append(at)
    return out


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise in a frame with y up, without collinear points."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(run):
        chain: list[tuple[float, float]] = []
        for p in run:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return half(points) + half(points[::-1])


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """An open line with no point further than ``tolerance`` from its chord dropped."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        (x0, y0), (x1, y1) = points[a], points[b]
        length = np.hypot(x1 - x0, y1 - y0)
        between = np.array(points[a + 1 : b], float)
        off = np.abs((x1 - x0) * (y0 - between[:, 1]) - (x0 - between[:, 0]) * (y1 - y0)) / length if length else np.hypot(between[:, 0] - x0, between[:, 1] - y0)
        worst = int(off.argmax())
        if off[worst] > tolerance:
            keep.add(a + 1 + worst)
            todo += [(a, a + 1 + worst), (a + 1 + worst, b)]
    return [points[i] for i in sorted(keep)] if points else []


def outlines(masks: DataFrame, side: int = SIDE, tolerance: float = 0.75) -> DataFrame:
    """The largest component of each mask as a polygon: its hull if it fills
    most of it, else its simplified contour."""

    def trace(batches):
        for batch in batches:
            rows = []
            for vec_id, mask in zip(batch["vec_id"], batch["mask"], strict=True):
                found = labels(np.asarray(mask).reshape(side, side))
                if not found.any():
                    continue
                sizes = np.bincount(found.ravel())[1:]
                part = filled(found == sizes.argmax() + 1)
                line = contour(part)
                around = hull(line)
                x, y = (np.array([p[i] for p in around], float) for i in (0, 1))
                area = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
                shape = around if area and part.sum() / (area + len(line)) >= 0.93 else simplified(line, tolerance)
                rows.append((vec_id, int(sizes.max()), len(line), [[float(a), float(b)] for a, b in shape]))
            yield pd.DataFrame(rows, columns=["vec_id", "area", "outline", "polygon"])

    return masks.select("vec_id", "mask").mapInPandas(trace, "vec_id long, area long, outline long, polygon array<array<double>>")


def pockets(masks: DataFrame, side: int = SIDE) -> DataFrame:
    """Holes of each mask, and how deep its background reaches in from the border."""

    def measure(batches):
        for batch in batches:
            rows = []
            for vec_id, mask in zip(batch["vec_id"], batch["mask"], strict=True):
                grid = np.asarray(mask).reshape(side, side)
                border = np.zeros(grid.shape, bool)
                border[[0, -1], :] = border[:, [0, -1]] = True
                rows.append((vec_id, int(((grid == 0) & ~outside(grid)).sum()), int(distances(grid == 0, border).max())))
            yield pd.DataFrame(rows, columns=["vec_id", "holes", "depth"])

    return masks.select("vec_id", "mask").mapInPandas(measure, "vec_id long, holes long, depth long")


def area_weights(source: int, target: int) -> np.ndarray:
    """How much of each source cell each target cell covers; rows sum to 1."""
    edges = np.arange(target + 1) * source / target
    low, high = np.arange(source), np.arange(source) + 1
    shared = np.minimum(edges[1:, None], high) - np.maximum(edges[:-1, None], low)
    return np.maximum(shared, 0) * target / source


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area-weighted resampling of a 2-D array."""
    return area_weights(image.shape[0], height) @ image @ area_weights(image.shape[1], width).T
