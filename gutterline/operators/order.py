"""Reading order and other page algorithms that recurse or fold.

A page's few boxes are one row with an array, and Python takes many such rows
at a time; everything before and after is relational.  ``place_in_order`` cuts a page along the line that slices its
panels least, rows before columns on a tie, and goes on inside each side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The most of a panel that a cut may slice off, and the shared height that
#: puts two panels in one row.
SLICE, SAME_ROW = 0.15, 0.5


def _area(points: np.ndarray) -> float:
    if len(points) < 3:
        return 0.0
    x, y = points[:, 0], points[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def _below(points: np.ndarray, axis: int, at: float) -> float:
    """Area of a polygon on the lower side of a line."""
    following = np.roll(points, -1, axis=0)
    kept: list[np.ndarray] = []
    for p, q in zip(points, following, strict=True):
        if p[axis] <= at:
            kept.append(p)
        if (p[axis] <= at) != (q[axis] <= at):
            kept.append(p + (q - p) * (at - p[axis]) / (q[axis] - p[axis]))
    return _area(np.array(kept)) if kept else 0.0


class _Shape:
    """A polygon with its bounds and area; one that fills its bounds is a box."""

    __slots__ = ("area", "high", "is_box", "low", "points")

    def __init__(self, points: np.ndarray) -> None:
        self.points, self.low, self.high, self.area = points, points.min(0).tolist(), points.max(0).tolist(), _area(points)
        self.is_box = self.area == (self.high[0] - self.low[0]) * (self.high[1] - self.low[1])

    @classmethod
    def of_box(cls, x: float, y: float, w: float, h: float) -> _Shape:
        """A box; no array is made for it."""
        out = cls.__new__(cls)
        x, y, right, bottom = float(x), float(y), float(x + w), float(y + h)
        out.points, out.low, out.high, out.is_box = None, [min(x, right), min(y, bottom)], [max(x, right), max(y, bottom)], True
        out.area = (out.high[0] - out.low[0]) * (out.high[1] - out.low[1])
        return out


def _best_cut(shapes: list[_Shape], axis: int, limit: float) -> tuple[float, list[int], list[int]] | None:
    """The first of the cuts that slice least: how much, and both sides."""
    best = None
    # a shape without area has no side
    solid = [(i, s.low[axis], s.high[axis], s.area, s) for i, s in enumerate(shapes) if s.area > 0]
    for at in sorted({v for s in shapes for v in (s.low[axis], s.high[axis])}):
        lower, upper, worst = [], [], 0.0
        for i, low, high, area, shape in solid:
            if high <= at:
                lower.append(i)
                continue
            if low >= at:
                upper.append(i)
                continue
            part = area * ((at - low) / (high - low)) if shape.is_box else _below(shape.points, axis, at)
            worst = max(worst, min(part, area - part) / area)
            if worst > limit:
                break
            (lower if part >= area - part else upper).append(i)
        if worst <= limit and lower and upper and (best is None or worst < best[0]):
            best = (worst, lower, upper)
            if worst == 0:
                break
    return best


def topological(shapes: list[np.ndarray], right_to_left: bool = True) -> list[int]:
    """Order of shapes that no cut parts: in a row by column, else by height;
    a cycle is broken by nearness to where reading starts."""
    return _by_precedence([_Shape(s) for s in shapes], right_to_left)


def _by_precedence(shapes: list[_Shape], right_to_left: bool) -> list[int]:
    n = len(shapes)
    after: list[list[int]] = [[] for _ in shapes]
    ahead = [0] * n
    for i in range(n):
        (low_i, top_i), (high_i, bottom_i) = shapes[i].low, shapes[i].high
        for j in range(i + 1, n):
            top_j, (high_j, bottom_j) = shapes[j].low[1], shapes[j].high
            if min(bottom_i, bottom_j) - max(top_i, top_j) > SAME_ROW * min(bottom_i - top_i, bottom_j - top_j):
                first = (high_i > high_j) == right_to_left
            else:
                first = top_i <= top_j
            before, later = (i, j) if first else (j, i)
            after[before].append(later)
            ahead[later] += 1
    waiting = sorted(range(n), key=lambda k: shapes[k].low[1] * 1e6 + (-shapes[k].high[0] if right_to_left else shapes[k].low[0]))
    out: list[int] = []
    while waiting:
        free = next((k for k in waiting if ahead[k] == 0), None)
        if free is None:
            return out + waiting
        out.append(free)
        waiting.remove(free)
        for k in after[free]:
            ahead[k] -= 1
    return out


def place_in_order(shapes: list[np.ndarray], right_to_left: bool = True, limit: float = SLICE) -> list[int]:
    """Indices of shapes in reading order; those without area drop out
    wherever a cut is made."""
    return _placed([_Shape(s) for s in shapes], right_to_left, limit)


def _placed(known: list[_Shape], right_to_left: bool, limit: float = SLICE) -> list[int]:
    done: list[int] = []
    stack = [list(range(len(known)))]
    while stack:
        some = stack.pop()
        if len(some) <= 1:
            done += some
            continue
        here = [known[i] for i in some]
        rows, columns = _best_cut(here, 1, limit), _best_cut(here, 0, limit)
        if rows and (not columns or rows[0] <= columns[0]):
            parts = [rows[1], rows[2]]
        elif columns:
            parts = [columns[2], columns[1]] if right_to_left else [columns[1], columns[2]]
        else:
            done += [some[k] for k in _by_precedence(here, right_to_left)]
            continue
        stack += [[some[k] for k in part] for part in reversed(parts)]
    return done


def corners(box: dict) -> np.ndarray:
    x, y, right, bottom = box["x"], box["y"], box["x"] + box["w"], box["y"] + box["h"]
    return np.array([[x, y], [right, y], [right, bottom], [x, bottom]], float)


def _values(column: pa.Array) -> list:
    plain = column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type))
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def _pages(rows: DataFrame, work, schema: str, *columns: str) -> DataFrame:
    """``work(boxes)`` on each page, its boxes as tuples of det_id, x, y, w, h
    and ``columns``, by det_id; what it returns are rows without the page.

    A page is one row with an array, so a batch carries many pages.
    """
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("det_id", *"xywh", *columns))).alias("boxes"))

    def run(batches):
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            boxes = list(zip(*(_values(c) for c in batch.column(1).flatten().flatten()), strict=True))
            out = [(page_id, *r) for page_id, a, b in zip(batch.column(0).to_pylist(), (ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist(), strict=True) for r in work(boxes[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(types), types, strict=True)], schema=types)

    types = to_arrow_schema(StructType.fromDDL(schema))
    return pages.mapInArrow(run, schema)


def _ordered(panels: DataFrame, how) -> DataFrame:
    def page(boxes):
        if len(boxes) == 1:
            return [(boxes[0][0], 0)]
        return [(boxes[k][0], place) for place, k in enumerate(how([_Shape.of_box(*b[1:5]) for b in boxes]))]

    return _pages(panels, page, "page_id long, det_id long, place long")


def reading_order(panels: DataFrame, right_to_left: bool = True) -> DataFrame:
    """page_id, det_id, place of each panel."""
    return _ordered(panels, lambda shapes: _placed(shapes, right_to_left))


def untangled(panels: DataFrame, right_to_left: bool = True) -> DataFrame:
    """As ``reading_order``, by precedence alone."""
    return _ordered(panels, lambda shapes: _by_precedence(shapes, right_to_left))


def _shared(a, b) -> float:
    return max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


#: Samples a side of the grid on which two outlines are compared.
OUTLINE_SAMPLES = 48


def _inside(points: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether places lie in a polygon, by rays to the right."""
    out = np.zeros(np.broadcast(x, y).shape, bool)
    for (x1, y1), (x2, y2) in zip(points, np.roll(points, -1, axis=0), strict=True):
        if y1 != y2:
            out ^= ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (x2 - x1) / (y2 - y1))
    return out


def outline_share(a: np.ndarray, b: np.ndarray) -> float:
    """How much of the smaller of two outlines lies in the other, by samples
    where their bounds cross."""
    low, high = np.maximum(a.min(0), b.min(0)), np.minimum(a.max(0), b.max(0))
    smaller = min(_area(a), _area(b))
    if (high <= low).any() or smaller <= 0:
        return 0.0
    step = (high - low) / OUTLINE_SAMPLES
    x, y = (low[i] + (np.arange(OUTLINE_SAMPLES) + 0.5) * step[i] for i in (0, 1))
    both = _inside(a, x[:, None], y[None]) & _inside(b, x[:, None], y[None])
    return float(both.sum() * step[0] * step[1] / smaller)


def join_boxes(boxes: list[list[float]], overlap: float = 0.5, column: float = 0.85, outlines: list[np.ndarray | None] | None = None) -> list[list[float]]:
    """Rectangles (x, y, w, h, conf) of one column that overlap by half of the
    smaller become one, again and again until none do.  Where both have
    outlines these must overlap as much; a joined rectangle is its own outline."""

    def one(i, j) -> bool:
        a, b = out[i], out[j]
        smaller = min(a[2] * a[3], b[2] * b[3])
        across = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
        if smaller <= 0 or _shared(a, b) / smaller < overlap or across / min(a[2], b[2]) < column:
            return False
        return shapes[i] is None and shapes[j] is None or outline_share(outline(i), outline(j)) >= overlap

    def outline(i) -> np.ndarray:
        return corners(dict(zip("xywh", out[i], strict=False))) if shapes[i] is None else shapes[i]

    out, shapes = [list(b) for b in boxes], list(outlines or [None] * len(boxes))
    while pair := next(((i, j) for i in range(len(out)) for j in range(i + 1, len(out)) if one(i, j)), None):
        a, b = out[pair[0]], out.pop(pair[1])
        shapes.pop(pair[1])
        x, y = min(a[0], b[0]), min(a[1], b[1])
        out[pair[0]] = [x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y, max(a[4], b[4])]
        shapes[pair[0]] = None
    return out


def joined_splits(panels: DataFrame) -> DataFrame:
    """Panels after joining those that were seen in two parts; a column
    ``polygon`` (an array of x and y), if there is one, gives their outlines."""
    outlined = ["polygon"] if "polygon" in panels.columns else []

    def page(boxes):
        best_first = sorted(boxes, key=lambda b: (-b[5], b[0]))
        outlines = [np.array([(p["x"], p["y"]) for p in b[6]], float) if outlined and b[6] else None for b in best_first]
        joined = join_boxes([[float(v) for v in b[1:6]] for b in best_first], outlines=outlines)
        return [(place, *box) for place, box in enumerate(joined)]

    return _pages(panels, page, "page_id long, place long, x double, y double, w double, h double, conf double", "conf", *outlined)


def lone_panels(texts: list[tuple], panels: list[tuple], width: float, height: float, least: float = 0.04) -> list[tuple]:
    """A panel in the gap around each text that lies in none; one that is
    added bounds the next."""
    added: list[tuple] = []
    known = [(*p, p[0] + p[2], p[1] + p[3]) for p in panels]
    for x, y, w, h in texts:
        right_end, low_end = x + w, y + h
        for px, py, _, _, pr, pb in known:
            across, down = min(right_end, pr) - max(x, px), min(low_end, pb) - max(y, py)
            if across > 0 and down > 0 and across * down / max(w * h, 1) >= 0.2:
                break
        else:
            column = [p for p in known if min(p[4], right_end) - max(p[0], x) > 0.1 * (right_end - x)]
            top = max([0.0, *(p[5] for p in column if p[5] <= y)])
            bottom = min([height, *(p[1] for p in column if p[1] >= low_end)])
            row = [p for p in known if min(p[5], bottom) - max(p[1], top) > 0.1 * (bottom - top)]
            left = max([0.0, *(p[4] for p in row if p[4] <= x)])
            right = min([width, *(p[0] for p in row if p[0] >= right_end)])
            if (right - left) * (bottom - top) >= least * width * height:
                added.append((left, top, right - left, bottom - top))
                known.append((*added[-1], left + (right - left), top + (bottom - top)))
    return added


def filled_around(texts: DataFrame, panels: DataFrame, width: int = 1000, height: int = 1500) -> DataFrame:
    """Panels added around texts that lie in none."""
    rows = texts.withColumn("panel", F.lit(False)).unionByName(panels.withColumn("panel", F.lit(True)))

    def page(boxes):
        of = lambda panel: [(float(b[1]), float(b[2]), float(b[3]), float(b[4])) for b in boxes if b[5] == panel]
        return [(place, *added) for place, added in enumerate(lone_panels(texts, of(True), width, height))] if (texts := of(False)) else []

    return _pages(rows, page, "page_id long, place long, x double, y double, w double, h double", "panel")


def smoothed(values: DataFrame) -> DataFrame:
    """``v`` mixed with its neighbours in the page; an edge stands in for the
    neighbour that it lacks."""
    near = Window.partitionBy("page_id").orderBy("det_id")
    mixed = 0.6 * F.col("v") + 0.2 * F.coalesce(F.lag("v").over(near), F.col("v")) + 0.2 * F.coalesce(F.lead("v").over(near), F.col("v"))
    return values.withColumn("smoothed", mixed)


def frames(panels: DataFrame, owned: DataFrame) -> DataFrame:
    """One frame for each panel: its place on the page and number of layers."""
    layers = owned.groupBy("page_id", "panel_id").agg(F.countDistinct("box_id").alias("layers"))
    rows = panels.withColumnRenamed("det_id", "panel_id").withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("y", "x", "panel_id")).cast("long"))
    return rows.join(layers, ["page_id", "panel_id"], "left").select("page_id", "panel_id", "place", F.coalesce("layers", F.lit(0).cast("long")).alias("layers"))
