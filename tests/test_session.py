from gutterline.streaming.session import Beat, Frame, Session, advance

FRAMES = [Frame([Beat(*b) for b in beats]) for beats in ([(0, False), (450, True), (900, True)], [(0, False)], [(0, False), (300, True)])]


def run(*commands, complete=True, frames=FRAMES, **more):
    s = Session()
    return s, [advance(s, frames, c, *a, complete=complete, **more) for c, *a in commands]


def test_tick_fires_in_order_and_moves_on():
    s, out = run(("tick", 500), ("tick", 500))
    assert out[0] == [("beat", 0, 0), ("beat", 0, 1)]
    assert out[1] == [("beat", 0, 2), ("frame", 1, -1)] and s.frame == 1 and s.elapsed == 0


def test_next_reveals_one_at_a_time_and_then_advances():
    _, out = run(("pause",), ("next",), ("next",), ("next",))
    assert out[1:] == [[("beat", 0, 0), ("beat", 0, 1)], [("beat", 0, 2)], [("frame", 1, -1)]]


def test_end_and_waiting():
    s, out = run(("seek", 9), ("next",), ("next",))
    assert out[0] == [("frame", 2, -1)] and out[2] == [("end", 2, -1)] and not s.playing
    s, out = run(("seek", 9), ("next",), ("next",), ("next",), complete=False)
    assert out[2:] == [[("waiting", 2, -1)], []] and s.waiting
    assert advance(s, [*FRAMES, Frame([Beat(0, False)])], "grew") == [("frame", 3, -1)] and not s.waiting


def test_reveal_all_stays_in_the_frame():
    s, out = run(("reveal_all",), ("reveal_all",))
    assert out == [[("beat", 0, 0), ("beat", 0, 1), ("beat", 0, 2)], []] and s.frame == 0


def test_prev_stops_at_the_start():
    assert run(("prev",))[1] == [[]]
    assert run(("seek", 2), ("prev",))[1][1] == [("frame", 1, -1)]


def test_no_frames():
    assert run(("tick", 5), ("next",), frames=[])[1] == [[], []]


def test_a_frame_ends_when_its_last_beat_has_been_held():
    frames = [Frame([Beat(0, False, 450), Beat(450, True, 300, 200), Beat(600, False, 100)]), Frame([]), Frame([Beat(0, False)])]
    s, out = run(("tick", 949), ("tick", 1), ("tick", 1), ("tick", 4998), ("tick", 1), frames=frames, fallback=5000)
    assert out[0] == [("beat", 0, 0), ("beat", 0, 1), ("beat", 0, 2)] and out[1] == [("frame", 1, -1)]
    assert out[2] == out[3] == [] and out[4] == [("frame", 2, -1)] and s.frame == 2


def test_a_held_frame_stays_and_a_step_lets_go():
    s, out = run(("hold",), ("tick", 5000), ("next",), ("next",))
    assert out[1] == [("beat", 0, 0), ("beat", 0, 1), ("beat", 0, 2)] and out[2] == [] and out[3] == [("frame", 1, -1)]
    assert run(("hold",), ("tick", 5000), ("release",), ("tick", 0))[1][3] == [("frame", 1, -1)]


def test_seeks_by_page_and_name():
    pages = [Frame([], 0, "a"), Frame([], 0, "b"), Frame([], 1, "c"), Frame([], 1, "d")]
    assert run(("seek_page", 1), ("seek_page", 7), frames=pages)[1] == [[("frame", 2, -1)], []]
    for name, to in (("d", 3), ("z", 2)):
        s = Session()
        assert advance(s, pages, "seek_frame", 1, name=name) == [("frame", to, -1)]
    whole = [Frame([], 0, "p0"), Frame([], 1, "p1")]
    s = Session(frame=3, elapsed=70)
    assert advance(s, whole, "source", before=pages) == [("frame", 1, -1)] and s.elapsed == 0
    assert advance(s, [Frame([], 5)], "source", before=whole) == [("frame", 0, -1)]


def test_stream_gives_the_table_s_events(spark, sf):
    from gutterline.plans.registry import QUERIES
    from gutterline.plans import source_queries  # noqa: F401

    table, stream = (QUERIES[n](spark, sf) for n in ("r2_director_events", "r2_director_stream"))
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, stream.collect()))
