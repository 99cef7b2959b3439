import numpy as np

from gutterline.operators import detections as ops, raster, store, timeline

SCHEMA = "page_id long, det_id long, cls string, x long, y long, w long, h long, conf double"


def frames(spark, *rows):
    return spark.createDataFrame([(1, i, "frame", *r) for i, r in enumerate(rows)], SCHEMA)


def test_dedupe_keeps_what_only_a_dropped_one_overlaps(spark):
    """A drops B; B overlaps C, A does not: C stays."""
    det = frames(spark, (0, 0, 100, 100, 0.9), (20, 0, 100, 100, 0.8), (40, 0, 100, 100, 0.7))
    assert sorted(r.det_id for r in ops.deduplicated(det, 0.6).collect()) == [0, 2]


def test_dedupe_ties_go_by_number(spark):
    det = frames(spark, (0, 0, 100, 100, 0.5), (1, 0, 100, 100, 0.5))
    assert [r.det_id for r in ops.deduplicated(det).collect()] == [0]


def test_dedupe_of_nothing(spark):
    assert ops.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rescue_counts_what_it_has_rescued(spark):
    det = frames(spark, (0, 0, 1000, 500, 0.9), (0, 600, 1000, 500, 0.2), (0, 650, 1000, 500, 0.1), (0, 0, 1000, 500, 0.15), (0, 1200, 100, 100, 0.2))
    assert [r.det_id for r in ops.rescued(det).collect()] == [1]


def test_merge_takes_the_surer_one(spark):
    first = frames(spark, (0, 0, 100, 100, 0.3), (500, 0, 100, 100, 0.9))
    second = spark.createDataFrame([(1, 7, "text", 5, 0, 100, 100, 0.6), (1, 8, "text", 505, 0, 100, 100, 0.1), (1, 9, "text", 900, 900, 50, 50, 0.2), (2, 10, "text", 0, 0, 9, 9, 0.5)], SCHEMA)
    out = sorted((r.page_id, r.pos, r.det_id) for r in ops.merged(first, second).collect())
    assert out == [(1, 0, 7), (1, 1, 1), (1, 2, 9), (2, 0, 10)]


def test_trimmed(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 0, 100, 100), (2, 0, 0, 0, 10, 10)], "page_id long, det_id long, x long, y long, w long, h long")
    out = {r.page_id: (r.x, r.y, r.w, r.h) for r in ops.trimmed(boxes, frames(spark, (80, 0, 100, 100, 0.5))).collect()}
    assert out == {1: (0, 0, 80, 100), 2: (0, 0, 10, 10)}


def test_beats(spark):
    rows = timeline.beats(spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0)], "panel long, ord long, ink double")).orderBy("seq").collect()
    assert [(r.seq, r.t, r.ms, r.hold, r.kind) for r in rows] == [(0, 0, 450, 0, "enter"), (1, 450, 300, 0, "reveal"), (2, 1000, 300, 0, "reveal"), (3, 2900, 0, 600, "rest")]


def test_durations_without_beats(spark):
    rows = spark.createDataFrame([(1, None, None, None), (2, 10, 5, None)], "panel long, t long, ms long, hold long")
    assert {r.panel: r.duration_ms for r in timeline.durations(rows, 2200).collect()} == {1: 2200, 2: 15}


def test_store(spark):
    log = spark.createDataFrame([(1, 10, "set"), (1, 20, "forget"), (2, 5, "set"), (2, 4, "forget")], "key long, at long, op string")
    assert [r.key for r in store.latest(log, "key", "at", deleted=log.op == "forget").collect()] == [2]
    assert [(r.key, r.op) for r in store.toggled(log, "key", "op").orderBy("key", "op").collect()] == [(1, "forget"), (1, "set"), (2, "forget"), (2, "set")]
    assert [r.at for r in store.newest(log, 2, "at").collect()] == [20, 10]
    pages = spark.createDataFrame([(1, 0), (1, 1), (1, 3), (2, 1)], "book long, idx long")
    assert sorted((r.book, r.idx) for r in store.prefix(pages, "book", "idx").collect()) == [(1, 0), (1, 1)]


def test_labels_and_floods():
    mask = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0]])
    assert raster.labels(mask).max() == 1 and raster.labels(mask, diagonal=False).max() == 2
    ring = np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]])
    assert not raster.outside(ring).any() and raster.filled(ring).all()
    assert raster.distances(np.ones((1, 4), bool), np.array([[True, False, False, False]])).tolist() == [[0, 1, 2, 3]]


def test_outline_hull_simplify():
    block = np.zeros((6, 6), int)
    block[1:4, 2:5] = 1
    line = raster.contour(block)
    assert len(line) == 8 and set(line) == {(x, y) for x in (2, 3, 4) for y in (1, 2, 3)} - {(3, 2)}
    assert set(raster.hull(line)) == {(2, 1), (4, 1), (4, 3), (2, 3)}
    assert raster.contour(np.zeros((2, 2), int)) == [] and raster.contour(np.ones((1, 1), int)) == [(0, 0)]
    assert raster.simplified([(0, 0), (1, 0.1), (2, 0), (3, 3)], 0.5) == [(0, 0), (2, 0), (3, 3)]


def test_resize_keeps_the_mean():
    image = np.arange(30.0).reshape(5, 6)
    assert np.allclose(raster.resized(image, 3, 4).mean(), image.mean())
    assert np.allclose(raster.resized(image, 5, 6), image)
