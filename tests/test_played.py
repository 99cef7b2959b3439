"""Sessions over books that grow: as a table, and as a stream in several batches."""

import json

import pytest

from gutterline.streaming import session

BEATS = json.dumps([{"t": 0, "reveals": False, "ms": 100, "hold": 0}, {"t": 100, "reveals": True, "ms": 50, "hold": 0}])


def frame(t, page, name, source="panels", beats="[]"):
    return (1, t, "frame", source, None, name, page, beats)


def ask(t, kind, amount=None, name=None):
    return (1, t, kind, None, amount, name, None, None)


def close(t, source="panels"):
    return (1, t, "close", source, None, None, None, None)


PANELS = [frame(0, 0, "a"), frame(0, 0, "b"), frame(0, 1, "c"), frame(0, 1, "d")]
PAGES = [frame(0, 0, "p0", "whole"), frame(0, 1, "p1", "whole"), frame(0, 2, "p2", "whole")]
CASES = {
    # the source changes on frame 3 of page 1: it stays on page 1, and goes back to that page's first frame
    "source": ([*PANELS, *PAGES, ask(1, "seek", 3), ask(2, "source", name="whole"), ask(3, "source", name="panels"), ask(4, "source", name="none")], [("frame", 3, -1), ("frame", 1, -1), ("frame", 2, -1)]),
    "seek_frame": ([*PANELS, ask(1, "seek_frame", 1, "d"), ask(2, "seek_frame", 1, "zz"), ask(3, "seek_frame", 9, "d"), ask(4, "seek_page", 0)], [("frame", 3, -1), ("frame", 2, -1), ("frame", 0, -1)]),
    # at the edge of an open book it waits, once, and goes on when a frame comes
    "waiting": ([frame(0, 0, "a"), ask(1, "next"), ask(2, "next"), ask(3, "tick", 9000), frame(4, 0, "b"), frame(5, 1, "c"), ask(6, "next"), ask(7, "next"), close(8), ask(9, "next")], [("waiting", 0, -1), ("frame", 1, -1), ("frame", 2, -1), ("waiting", 2, -1), ("end", 2, -1)]),
    # frames that come before the edge is reached, or to another source, wake nobody
    "grew": ([frame(0, 0, "a"), ask(1, "tick", 10), frame(2, 0, "b"), frame(3, 0, "p0", "whole"), ask(4, "next"), ask(5, "next"), frame(6, 1, "p1", "whole"), frame(7, 1, "c")], [("frame", 1, -1), ("waiting", 1, -1), ("frame", 2, -1)]),
    # going back from the edge ends the waiting
    "back": ([frame(0, 0, "a"), frame(0, 0, "b"), ask(1, "next"), ask(2, "next"), ask(3, "prev"), frame(4, 0, "c")], [("frame", 1, -1), ("waiting", 1, -1), ("frame", 0, -1)]),
    "beats": ([frame(0, 0, "a", beats=BEATS), ask(1, "next"), ask(2, "tick", 50), frame(3, 0, "b")], [("beat", 0, 0), ("beat", 0, 1), ("waiting", 0, -1), ("frame", 1, -1)]),
    "nothing": ([ask(1, "next"), ask(2, "source", name="panels"), frame(3, 0, "a"), ask(4, "prev")], []),
}


def rows_of(cases):
    return [(key, *row[1:]) for key, (rows, _) in enumerate(cases.values()) for row in rows]


def by_key(events):
    out = {}
    for r in sorted(events, key=lambda r: (r.key, r.n)):
        out.setdefault(r.key, []).append((r.kind, r.frame, r.beat))
    return {name: out.get(key, []) for key, name in enumerate(CASES)}


def test_table(spark):
    events = session.played(spark.createDataFrame(rows_of(CASES), session.PLAYED)).collect()
    assert by_key(events) == {name: expected for name, (_, expected) in CASES.items()}
    assert session.played(spark.createDataFrame([], session.PLAYED)).count() == 0


def test_table_keeps_long_numbers_and_unknown_times(spark):
    """A column with nulls isn't turned to doubles; a row without a time comes last."""
    far = (1 << 53) + 1
    rows = [frame(0, far - 1, "a"), frame(0, far, "b"), ask(1, "seek_page", far), ask(None, "prev"), *((2, *r[1:]) for r in (ask(1, "next"), close(2)))]
    events = session.played(spark.createDataFrame(rows, session.PLAYED)).orderBy("n").collect()
    assert [tuple(r) for r in events] == [(1, 1, 0, "frame", 1, -1), (1, None, 1, "frame", 0, -1)]


@pytest.mark.parametrize("batches", [1, 3])
def test_stream(spark, tmp_path, batches):
    """Frames and commands come as two streams, in files by time; a state outlives each batch."""
    rows = sorted(rows_of(CASES), key=lambda r: r[1])
    for n in range(batches):
        part = [r for r in rows if min(r[1] * batches // 10, batches - 1) == n]
        for name, own in (("frames", [r for r in part if r[2] in ("frame", "close")]), ("asked", [r for r in part if r[2] not in ("frame", "close")])):
            spark.createDataFrame(own, session.PLAYED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/{n}")
    read = lambda name: spark.readStream.schema(session.PLAYED).option("maxFilesPerTrigger", 1 if batches > 1 else 1000).parquet(f"{tmp_path}/{name}/*")
    events = session.drained(session.played(read("frames").unionByName(read("asked"))), f"file://{tmp_path}/out").collect()
    assert by_key(events) == {name: expected for name, (_, expected) in CASES.items()}


def test_queries_agree(spark, sf):
    """Frames that wait, grow and change sources are in the tables' sessions, and the stream's events are the table's."""
    from gutterline.plans import source_queries  # noqa: F401
    from gutterline.plans.registry import QUERIES

    table, stream = ([tuple(r) for r in QUERIES[n](spark, sf).collect()] for n in ("r4_growing_sessions", "r5_growing_stream"))
    assert sorted(table) == sorted(stream) and {"frame", "beat", "waiting"} <= {r[3] for r in table}
