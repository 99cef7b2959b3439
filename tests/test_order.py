"""Layouts whose reading order is known; input is given backwards."""

import numpy as np
import pytest

from gutterline.operators import order
from gutterline.operators.order import join_boxes, lone_panels, outline_share, place_in_order, topological


def rect(x, y, w, h):
    return np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)


LAYOUTS = {
    "one": [(0, 0, 1000, 1500)],
    "rows": [(0, 0, 1000, 480), (0, 500, 1000, 480), (0, 1000, 1000, 500)],
    "two by two": [(510, 0, 490, 740), (0, 0, 490, 740), (510, 760, 490, 740), (0, 760, 490, 740)],
    "row in columns": [(0, 0, 1000, 480), (680, 500, 320, 480), (340, 500, 320, 480), (0, 500, 320, 480)],
    "tall beside two": [(510, 0, 490, 1500), (0, 0, 490, 740), (0, 760, 490, 740)],
    "narrow gutter": [(505, 0, 495, 700), (0, 5, 495, 700), (0, 712, 1000, 700)],
    "overlapping": [(0, 0, 900, 800), (50, 500, 900, 900)],
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    shapes = [rect(*b) for b in LAYOUTS[name]]
    backwards = shapes[::-1]
    assert place_in_order(backwards) == list(range(len(shapes)))[::-1]


def test_left_to_right():
    shapes = [rect(0, 0, 490, 740), rect(510, 0, 490, 740), rect(0, 760, 490, 740), rect(510, 760, 490, 740)]
    assert place_in_order(shapes, right_to_left=False) == [0, 1, 2, 3]


def test_permutation_of_a_grid():
    shapes = [rect(260 * i, 380 * j, 240, 360) for i in range(4) for j in range(4)]
    assert sorted(place_in_order(shapes)) == list(range(16))


def test_diagonal_gutter():
    right = np.array([[480, 0], [1000, 0], [1000, 700], [420, 700]], float)
    left = np.array([[0, 0], [460, 0], [400, 700], [0, 700]], float)
    assert place_in_order([left, right]) == [1, 0]


def test_shape_without_area_drops_out_of_a_cut():
    shapes = [rect(0, 0, 100, 100), rect(0, 200, 0, 50), rect(0, 300, 100, 100)]
    assert place_in_order(shapes) == [0, 2]


def test_topological_breaks_ties_by_column():
    shapes = [rect(0, 0, 400, 400), rect(300, 10, 400, 400)]
    assert topological(shapes) == [1, 0]
    assert topological(shapes, right_to_left=False) == [0, 1]


def test_join_boxes():
    halves = [[0, 0, 100, 300, 0.5], [2, 120, 100, 300, 0.9], [400, 0, 100, 100, 0.3]]
    assert join_boxes(halves) == [[0, 0, 102, 420, 0.9], [400, 0, 100, 100, 0.3]]
    assert join_boxes([]) == []


def test_lone_panels_fill_the_gap():
    panels = [(0, 0, 1000, 400), (0, 900, 1000, 600)]
    assert lone_panels([(300, 600, 100, 50)], panels, 1000, 1500) == [(0.0, 400, 1000, 500)]
    assert lone_panels([(300, 600, 100, 50), (500, 700, 50, 50)], panels, 1000, 1500) == [(0.0, 400, 1000, 500)]


def test_outlines_must_overlap_too():
    """Two halves of a diagonal cut: their bounds overlap, they don't."""
    upper, lower = np.array([[0, 0], [100, 0], [0, 400]], float), np.array([[100, 0], [100, 400], [0, 400]], float)
    boxes = [[0, 0, 100, 400, 0.9], [0, 0, 100, 400, 0.8]]
    assert join_boxes(boxes, outlines=[upper, lower]) == boxes and len(join_boxes(boxes)) == 1
    assert len(join_boxes(boxes, outlines=[upper, upper + 5])) == 1 and len(join_boxes(boxes, outlines=[upper, None])) == 1
    assert abs(outline_share(upper, rect(0, 0, 100, 400)) - 1) < 0.05 and outline_share(upper, rect(200, 0, 9, 9)) == 0
    assert abs(outline_share(rect(0, 0, 100, 100), rect(50, 0, 100, 100)) - 0.5) < 1e-9


def test_box_and_polygon_paths_agree():
    """A box with a point too many on a side goes the polygon's way."""
    rng = np.random.default_rng(3)
    for _ in range(150):
        boxes = [rect(*rng.integers(0, 900, 2), *rng.integers(20, 500, 2)) for _ in range(rng.integers(2, 9))]
        bent = [np.vstack([b[:1], (b[:1] + b[1:2]) / 2 + [[0, 1e-9]], b[1:]]) for b in boxes]
        assert place_in_order(boxes) == place_in_order(bent)


def test_pages_of_boxes_make_no_arrays(spark):
    """Boxes go as plain numbers; a page of one panel isn't looked at."""
    rng = np.random.default_rng(4)
    pages = [[rng.integers(0, 900, 4).tolist() for _ in range(rng.integers(2, 9))] for _ in range(200)]
    for by in (place_in_order, topological):
        assert [by([rect(*b) for b in p]) for p in pages] == [(order._placed if by is place_in_order else order._by_precedence)([order._Shape.of_box(*b) for b in p], True) for p in pages]
    rows = [(n, i, *b) for n, p in enumerate(pages[:9]) for i, b in enumerate(p)] + [(99, 7, 1, 2, 3, 4)]
    found = order.reading_order(spark.createDataFrame(rows, "page_id long, det_id long, x long, y long, w long, h long")).collect()
    expected = {(n, k, place) for n, p in enumerate(pages[:9]) for place, k in enumerate(place_in_order([rect(*b) for b in p]))}
    assert {tuple(r) for r in found} == expected | {(99, 7, 0)} and len(found) == len(expected) + 1
