"""Playback sessions and frame windows as streams.

A session replays frames by commands.  ``advance`` is the whole state
machine: state and one command in, new state and events out.  It runs under
``applyInPandasWithState`` on a stream and under ``applyInPandas`` on a table;
both give the same events.

Books that grow while they are read are sessions of their own: frames and
commands are rows of one table or stream, and ``played`` keeps the frames so
far in a list state beside the session's.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

EVENTS = "key long, t long, n long, kind string, frame long, beat long"
STATE = "frame long, elapsed long, fired long, playing boolean, waiting boolean, held boolean, seen long"
#: How long a frame without beats stays, in ms.
DEFAULT_HOLD = 4000


@dataclass
class Session:
    frame: int = 0
    elapsed: int = 0
    fired: int = 0
    playing: bool = True
    waiting: bool = False
    held: bool = False
    seen: int = 0


class Beat(NamedTuple):
    t: int
    reveals: bool
    ms: int = 0
    hold: int = 0


@dataclass
class Frame:
    """Beats by time; the page and the name of the frame on it."""

    beats: list[Beat]
    page: int = 0
    name: str = ""
    #: What the beats were read from, where they came as JSON.
    text: str = ""

    def duration(self, fallback: int) -> int:
        """Until the last of its beats is over and has been held."""
        return max((b.t + b.ms + b.hold for b in self.beats), default=fallback)


def _fire(s: Session, beats: list[Beat], until: float) -> list[tuple[str, int, int]]:
    out = []
    while s.fired < len(beats) and beats[s.fired].t <= until:
        out.append(("beat", s.frame, s.fired))
        s.fired += 1
    return out


def _seek(s: Session, to: int, n: int) -> list[tuple[str, int, int]]:
    s.frame, s.elapsed, s.fired, s.waiting = min(max(to, 0), n - 1), 0, 0, False
    return [("frame", s.frame, -1)]


def first_of_page(frames: list[Frame], page: int, name: str | None = None) -> int | None:
    """The first frame of a page, or the one of that name if the page has it."""
    on_page = [i for i, f in enumerate(frames) if f.page == page]
    return next((i for i in on_page if frames[i].name == name), next(iter(on_page), None))


def _next(s: Session, frames: list[Frame], complete: bool) -> list[tuple[str, int, int]]:
    if s.held:  # this step lets go of what holds the frame
        s.held = False
        return []
    beats = frames[s.frame].beats
    pending = next((b.t for b in beats[s.fired :] if b.reveals), None)
    if pending is not None:
        s.elapsed = max(s.elapsed, pending)
        return _fire(s, beats, s.elapsed)
    out = _fire(s, beats, float("inf"))
    if s.frame < len(frames) - 1:
        return out + _seek(s, s.frame + 1, len(frames))
    if complete:
        s.playing = False
        return [*out, ("end", s.frame, -1)]
    if not s.waiting:
        s.waiting = True
        out.append(("waiting", s.frame, -1))
    return out


def advance(s: Session, frames: list[Frame], command: str, amount: int = 0, complete: bool = True, name: str | None = None, fallback: int = DEFAULT_HOLD, before: list[Frame] | None = None) -> list[tuple[str, int, int]]:
    """Apply one command: tick (by ``amount`` ms), next, prev, seek (to
    ``amount``), seek_page (the first frame of page ``amount``), seek_frame
    (the one of that ``name`` there, or the page), source (``frames`` have
    taken the place of ``before``: to the same page), hold and release (while
    a frame is held it doesn't end, and a step only lets go), reveal_all,
    grew, play, pause, toggle.  Events are (kind, frame, beat)."""
    if not frames:
        return []
    if command == "source":
        page = before[s.frame].page if before else 0
        return _seek(s, first_of_page(frames, page) or 0, len(frames))
    beats = frames[s.frame].beats
    if command == "tick":
        s.elapsed += amount
        out = _fire(s, beats, s.elapsed)
        if s.playing and not s.waiting and not s.held and s.elapsed >= frames[s.frame].duration(fallback):
            out += _next(s, frames, complete)
        return out
    if command == "next":
        return _next(s, frames, complete)
    if command == "prev":
        return _seek(s, s.frame - 1, len(frames)) if s.frame > 0 else []
    if command == "seek":
        return _seek(s, amount, len(frames))
    if command in ("seek_page", "seek_frame"):
        to = first_of_page(frames, amount, name if command == "seek_frame" else None)
        return [] if to is None else _seek(s, to, len(frames))
    if command == "reveal_all":
        last = max((b.t for b in beats if b.reveals), default=-1)
        if last < 0:
            return []
        s.elapsed = max(s.elapsed, last)
        return _fire(s, beats, s.elapsed)
    if command == "grew":
        return _seek(s, s.frame + 1, len(frames)) if s.waiting and s.frame < len(frames) - 1 else []
    if command in ("hold", "release"):
        s.held = command == "hold"
    if command in ("play", "pause", "toggle"):
        s.playing = {"play": True, "pause": False, "toggle": not s.playing}[command]
    return []


def _frames_of(rows: pd.DataFrame) -> list[Frame]:
    """The session's frames, from the first of the rows that carry them."""
    first = rows["frames"].iloc[0] if len(rows) else None
    if first is None:
        return []
    return [Frame([Beat(int(b["t"]), bool(b["reveals"]), int(b["ms"]), int(b["hold"])) for b in f["beats"]], int(f["page"]), f["name"]) for f in first]


def _replayed(s: Session, key: int, rows: pd.DataFrame, frames: list[Frame]) -> pd.DataFrame:
    out = []
    for row in rows.sort_values(["t", "command"]).itertuples():
        for kind, frame, beat in advance(s, frames, row.command, int(row.amount)):
            out.append((key, row.t, s.seen, kind, frame, beat))
            s.seen += 1
    return pd.DataFrame(out, columns=["key", "t", "n", "kind", "frame", "beat"])


def replayed(commands: DataFrame, books: DataFrame) -> DataFrame:
    """Events of all sessions: ``commands`` has key, t, command, amount,
    ``books`` the frames of each key once."""

    def session(key, rows, book):
        return _replayed(Session(), key[0], rows, _frames_of(book))

    return commands.groupBy("key").cogroup(books.groupBy("key")).applyInPandas(session, EVENTS)


def replay_stream(commands: DataFrame) -> DataFrame:
    """The same over a stream of commands that carry their session's frames;
    its state is kept from batch to batch."""

    def session(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = Session(*state.get) if state.exists else Session()
        rows = pd.concat(list(batches))
        if len(rows):
            yield _replayed(s, key[0], rows, _frames_of(rows))
        state.update((s.frame, s.elapsed, s.fired, s.playing, s.waiting, s.held, s.seen))

    return commands.groupBy("key").applyInPandasWithState(session, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


#: What grows and what is asked, in one table: a ``frame`` row brings a frame of
#: a source (its page, name and beats as JSON), a ``close`` row says that the
#: source is complete, any other kind is a command with its amount or name.
PLAYED = "key long, t long, kind string, source string, amount long, name string, page long, beats string"
_FRAME = "source string, page long, name string, beats string"


@dataclass
class Shelf:
    """The frames so far of each source, which sources are complete, and which is played."""

    frames: dict[str, list[Frame]] = field(default_factory=dict)
    closed: set[str] = field(default_factory=set)
    source: str | None = None

    def add(self, source: str, page: int, name: str, beats: str) -> None:
        self.frames.setdefault(source, []).append(Frame([Beat(int(b["t"]), bool(b["reveals"]), int(b["ms"]), int(b["hold"])) for b in json.loads(beats or "[]")], page, name, beats))

    def answer(self, s: Session, row) -> list[tuple[str, int, int]]:
        """The events of one row.  A session plays the source of its first
        frame; a frame that comes to the played source wakes who waits for it."""
        if row.kind == "frame":
            self.add(row.source, int(row.page), row.name, row.beats)
            self.source = row.source if self.source is None else self.source
            return advance(s, self.frames[row.source], "grew") if row.source == self.source else []
        if row.kind == "close":
            self.closed.add(row.source)
            return []
        playing = self.frames.get(self.source, [])
        if row.kind == "source":
            if not (to := self.frames.get(row.name)):
                return []
            self.source = row.name
            return advance(s, to, "source", before=playing)
        return advance(s, playing, row.kind, int(row.amount or 0), complete=self.source in self.closed, name=row.name)


class Row(NamedTuple):
    """A row like ``PLAYED``, but for its key and with None for what it lacks."""

    t: int
    kind: str
    source: str | None
    amount: int | None
    name: str | None
    page: int | None
    beats: str | None


_RANKS = {"frame": 0, "close": 1}


def _order(row: Row) -> tuple:
    """By time, frames before what is asked; what a row lacks comes last."""
    lacking = lambda v: (v is None, 0 if v is None else v)
    return (lacking(row.t), _RANKS.get(row.kind, 2), *map(lacking, (row.kind, row.source, row.page, row.name, row.amount)))


def _columns(rows: pd.DataFrame) -> Iterator[Row]:
    """Rows of a pandas table, whose longs with nulls have become doubles."""
    lists = [rows[c].tolist() for c in Row._fields]
    return map(Row._make, zip(*([None if v is None or v != v else v for v in column] for column in lists), strict=True))


def _events(rows: Iterable[Row], s: Session, shelf: Shelf) -> list[tuple]:
    """Events (t, n, kind, frame, beat) of rows of one session, in their order."""
    rows, out = list(rows), []
    if not shelf.frames and not any(r.kind == "frame" for r in rows):  # nothing to play, whatever is asked
        shelf.closed.update(r.source for r in rows if r.kind == "close")
        return out
    for row in sorted(rows, key=_order):
        for kind, frame, beat in shelf.answer(s, row):
            out.append((row.t, s.seen, kind, frame, beat))
            s.seen += 1
    return out


class Playback(StatefulProcessor):
    """A session over a book that grows: its own state, and a list of frames to which batches only add."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", f"{STATE}, source string, closed string")
        self.frames = handle.getListState("frames", _FRAME)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        shelf, s = Shelf(), Session()
        if self.session.exists():
            *kept, shelf.source, closed = self.session.get()
            s, shelf.closed = Session(*kept), set(json.loads(closed))
            for frame in self.frames.get():
                shelf.add(*frame)
        before = {source: len(frames) for source, frames in shelf.frames.items()}
        found = _events(itertools.chain.from_iterable(map(_columns, rows)), s, shelf)
        yield pd.DataFrame([(key[0], *e) for e in found], columns=["key", "t", "n", "kind", "frame", "beat"])
        if added := [(source, f.page, f.name, f.text) for source, frames in shelf.frames.items() for f in frames[before.get(source, 0) :]]:
            self.frames.appendList(added)
        self.session.update((s.frame, s.elapsed, s.fired, s.playing, s.waiting, s.held, s.seen, shelf.source, json.dumps(sorted(shelf.closed))))

    def close(self) -> None:
        pass


def played(rows: DataFrame) -> DataFrame:
    """Events of sessions over growing books, from rows like ``PLAYED``: a
    table, or a stream, whose state store has to keep lists (RocksDB).

    Rows of a session are taken by time, frames before what is asked at that
    time; frames of one time come by source, page and name.  A stream's batch
    is taken whole before the next one.
    """
    rows = rows.select([c.split()[0] for c in PLAYED.split(", ")])
    if rows.isStreaming:
        return rows.groupBy("key").transformWithStateInPandas(Playback(), EVENTS, "Append", "None")

    types = to_arrow_schema(StructType.fromDDL(EVENTS))

    def session(key, own):
        found = _events(map(Row._make, zip(*(own.column(c).to_pylist() for c in Row._fields), strict=True)), Session(), Shelf())
        columns = zip(*found) if found else [[]] * (len(types) - 1)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(found), pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(types)[1:], strict=True))], schema=types)

    return rows.groupBy("key").applyInArrow(session, EVENTS)


def frame_windows(marks: DataFrame, late: str = "1 minute") -> DataFrame:
    """Tumbling windows of ten seconds over (ts, event_type, value): rows,
    errors and the worst value.  Rows later than the watermark are dropped."""
    grouped = marks.withWatermark("ts", late).groupBy(F.window("ts", "10 seconds").alias("w"))
    counted = grouped.agg(F.count("*").alias("marks"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max(F.floor(F.col("value") * 1000)).alias("worst"))
    return counted.select(F.unix_seconds("w.start").alias("start_s"), "marks", "errors", "worst")


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into Parquet files; their rows."""
    spark = stream.sparkSession
    keeper = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(keeper)
    spark.conf.set(keeper, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the query takes it when it starts
    running = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").trigger(availableNow=True).start()
    spark.conf.set(keeper, before)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
