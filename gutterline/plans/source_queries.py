"""Queries through sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import timeline
from ..sources import archive, loose, pages
from ..sources.shared import new_folder
from ..streaming import session
from .inputs import DETECTIONS_SQL, detections, table
from .profiles import BROWSER
from .registry import query
from .timeline_queries import dialogue

#: Page numbers to a book: a book stays small, and their number grows with the pages.
PAGES = 200
_ENTRY = "'p' || lpad(cast(page_id as varchar(20)), 8, '0') || '.html'"


@query("s1_archive_roundtrip", f"select cast(page_id // {PAGES} as varchar) as book, {_ENTRY} as name, cast(octet_length(encode(coalesce(html, ''))) as bigint) as size, sha256(coalesce(html, '')) as digest from pages")
def archive_roundtrip(spark, sf):
    """Pages written to an archive for each book and read back."""
    path = new_folder(spark, "books")
    archive.write_books(table(spark, sf, "pages").select(F.expr(f"page_id div {PAGES}").alias("book"), F.expr(_ENTRY).alias("name"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("data")), path)
    return archive.read_books(spark, path).select("book", "name", "size", F.sha2("data", 256).alias("digest"))


@query("s7_loose_files", f"select cast(page_id // {PAGES} as varchar) as book, 'p' || page_id || '.png' as name, row_number() over (partition by page_id // {PAGES} order by page_id) - 1 as place, cast(octet_length(encode(coalesce(html, ''))) as bigint) as size, sha256(coalesce(html, '')) as digest from pages")
def loose_files(spark, sf):
    """Pages as files of their own, read back in natural order."""
    path = new_folder(spark, "loose")
    rows = table(spark, sf, "pages").withColumn("kind", F.explode(F.array(F.lit(".png"), F.lit(".txt"))))  # the texts aren't pages
    named = F.concat(F.lit("p"), F.col("page_id").cast("string"), "kind")
    loose.write_files(rows.select(F.expr(f"page_id div {PAGES}").alias("book"), named.alias("name"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("data")), path)
    return loose.read_files(spark, path).select("book", "name", "place", "size", F.sha2("data", 256).alias("digest"))


@query("s14_changed_archives", f"select cast(page_id // {PAGES} as varchar) as book, count(*) as entries, bool_or(page_id % 1000 = 7) as rewritten from pages group by 1")
def changed_archives(spark, sf):
    """Books written, then written again with a few pages changed: only those books are."""
    path = new_folder(spark, "books")
    entries = table(spark, sf, "pages").select("page_id", F.expr(f"page_id div {PAGES}").alias("book"), F.expr(_ENTRY).alias("name"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("data"))
    loose.write_changed(entries, path)
    again = loose.write_changed(entries.withColumn("data", F.when(F.col("page_id") % 1000 == 7, F.concat("data", F.lit(b"!"))).otherwise(F.col("data"))), path)
    listed = archive.listed(spark, path).groupBy("book").agg(F.count("*").alias("entries"))
    return listed.join(again.withColumn("rewritten", F.lit(True)), "book", "left").select("book", "entries", F.coalesce("rewritten", F.lit(False)).alias("rewritten"))


@query("s3_archive_listing", f"select cast(page_id // {PAGES} as varchar) as book, count(*) as entries, min({_ENTRY}) as first_name from pages group by 1")
def archive_listing(spark, sf):
    """Entries are listed, not inflated."""
    path = new_folder(spark, "books")
    archive.write_books(table(spark, sf, "pages").select(F.expr(f"page_id div {PAGES}").alias("book"), F.expr(_ENTRY).alias("name"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("data")), path)
    return archive.listed(spark, path).groupBy("book").agg(F.count("*").alias("entries"), F.min("name").alias("first_name"))


@query("s12_stored_pages", "select page_id, 'p' || page_id as id, cast(length(coalesce(html, '')) as bigint) as size, sha256(coalesce(html, '')) as digest from pages")
def stored_pages(spark, sf):
    html = F.coalesce("html", F.lit(""))
    header = F.struct(F.col("page_id").alias("index"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.length(html).cast("long").alias("size"))
    rows = table(spark, sf, "pages").select(pages.encoded(header, F.encode(html, "UTF-8")).alias("page")).select(pages.decoded(F.col("page")).alias("d"))
    return rows.select(F.col("d.header.index").alias("page_id"), "d.header.id", "d.header.size", F.sha2("d.body", 256).alias("digest"))


@query(
    "s18_manifest_roundtrip",
    f"with {DETECTIONS_SQL} select page_id // {PAGES} as book, page_id, count(*) as panels, min(x) as least_x, max(conf) as best from det where cls = 'frame' group by 1, 2",
)
def manifest_roundtrip(spark, sf):
    """Panels to one JSON manifest a book, parsed again and flattened."""
    place = (F.row_number().over(Window.partitionBy("page_id").orderBy("det_id")) - 1).alias("place")
    made = pages.manifests(detections(spark, sf, "frame").select("*", place), F.expr(f"page_id div {PAGES}"), (1000, 1500))
    parsed = made.select("book", pages.parsed_manifest(F.col("manifest")).alias("m")).where(F.size(pages.problems(F.col("m"))) == 0)
    panels = parsed.select("book", F.explode("m.pages").alias("p")).select("book", F.col("p.id").cast("long").alias("page_id"), F.explode("p.panels").alias("k"))
    return panels.groupBy("book", "page_id").agg(F.count("*").alias("panels"), F.min(F.get("k.bbox", F.lit(0)).cast("long")).alias("least_x"), F.max("k.conf").alias("best"))


def session_books(spark, sf):
    """The frames of each key's session: those of the conversation of its
    number, a frame for each turn, three to a page."""
    beat = lambda t, reveals, ms, hold: F.struct(t.cast("long").alias("t"), F.lit(reveals).alias("reveals"), F.lit(ms).cast("long").alias("ms"), hold.cast("long").alias("hold"))
    enter, reveal, tail, read = BROWSER.enter_ms, BROWSER.reveal_ms, BROWSER.tail_ms, timeline.read_ms(F.col("ink"))
    beats = F.array(beat(F.lit(0), False, enter, F.lit(0)), beat(F.lit(enter), True, reveal, read), beat(F.lit(enter + reveal) + read, False, 0, F.lit(tail)))
    frames = dialogue(spark, sf).select("panel", "ord", F.struct(beats.alias("beats"), F.floor(F.col("ord") / 3).cast("long").alias("page"), F.col("ord").cast("string").alias("name")).alias("frame"))
    return frames.groupBy(F.col("panel").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "frame"))), lambda e: e.frame).alias("frames"))


def commands(spark, sf, rows=None):
    """Commands of each user from its events."""
    kind = F.when(F.col("event_type") == "view", "tick").when(F.col("event_type") == "click", "next").when(F.col("event_type") == "purchase", "reveal_all").when(F.col("event_type") == "signup", "prev").otherwise("seek")
    amount = F.when(F.col("event_type") == "error", F.floor(F.col("value")) % 5).otherwise(F.floor(F.col("value") * 20)).cast("long")
    rows = table(spark, sf, "events") if rows is None else rows
    return rows.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), kind.alias("command"), amount.alias("amount"))


@query("r2_director_events")
def director_events(spark, sf):
    asked = commands(spark, sf)
    return session.replayed(asked, session_books(spark, sf).join(asked.select("key").distinct(), "key", "left_semi"))


def played_rows(spark, sf, rows=None):
    """Frames and commands of sessions over books that grow: the frames of a
    session, by panel and by page, come evenly over the time of its events."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    times = events.groupBy("key").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    books = session_books(spark, sf).join(times, "key")
    nothing = lambda kind: F.lit(None).cast(kind)
    at = F.col("first") + F.floor((F.col("last") - F.col("first")) * F.col("pos") / F.size("frames"))
    panels = books.select("*", F.posexplode("frames").alias("pos", "f")).select("key", at.alias("t"), F.lit("frame").alias("kind"), F.lit("panels").alias("source"), nothing("long").alias("amount"), F.col("f.name").alias("name"), F.col("f.page").alias("page"), F.to_json("f.beats").alias("beats"))
    pages = panels.groupBy("key", "page").agg(F.min("t").alias("t"), F.min_by("beats", "t").alias("beats")).select("key", "t", F.lit("frame").alias("kind"), F.lit("whole").alias("source"), nothing("long").alias("amount"), F.concat(F.lit("p"), F.col("page").cast("string")).alias("name"), "page", "beats")
    closed = books.select("key", F.col("last").alias("t"), F.lit("close").alias("kind"), F.explode(F.array(F.lit("panels"), F.lit("whole"))).alias("source"), nothing("long").alias("amount"), nothing("string").alias("name"), nothing("long").alias("page"), nothing("string").alias("beats"))
    rows = table(spark, sf, "events") if rows is None else rows
    value = F.floor(F.col("value")).cast("long")
    kind = F.when(F.col("event_type") == "view", "tick").when(F.col("event_type") == "click", "next").when(F.col("event_type") == "purchase", "reveal_all").when(F.col("event_type") == "signup", "source").otherwise("seek_frame")
    name = F.when(kind == "source", F.when(value % 2 == 0, "whole").otherwise("panels")).otherwise((value % 7).cast("string"))
    asked = rows.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), kind.alias("kind"), nothing("string").alias("source"), F.when(kind == "tick", value * 20).otherwise(value % 3).alias("amount"), name.alias("name"), nothing("long").alias("page"), nothing("string").alias("beats"))
    return panels.unionByName(pages).unionByName(closed), asked


@query("r4_growing_sessions")
def growing_sessions(spark, sf):
    """Sessions that wait at the edge of a growing book, go on when it grows, and change sources."""
    frames, asked = played_rows(spark, sf)
    return session.played(frames.unionByName(asked))


@query("r5_growing_stream")
def growing_stream(spark, sf):
    """The same from two streams, of frames and of commands, into one state."""
    folder = new_folder(spark, "growing")
    frames, asked = played_rows(spark, sf, event_stream(spark, sf))
    frames.write.parquet(f"{folder}/frames")
    coming = spark.readStream.schema(frames.schema).parquet(f"{folder}/frames")
    return session.drained(session.played(coming.unionByName(asked)), folder)


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")


@query("r2_director_stream")
def director_stream(spark, sf):
    """The same events from a stream with a state for each session."""
    return session.drained(session.replay_stream(commands(spark, sf, event_stream(spark, sf)).join(session_books(spark, sf), "key", "left")), new_folder(spark, "director"))


@query("r7_window_stream", "with w as (select cast(floor(epoch_us(ts) / cast(10000000 as double)) as bigint) * 10 as start_s, count(*) as marks, count(*) filter (event_type = 'error') as errors, max(cast(floor(value * cast(1000 as double)) as bigint)) as worst from events group by 1) select * from w where start_s + 10 <= (select epoch_us(max(ts)) / 1000000.0 - 60 from events)")
def window_stream(spark, sf):
    """Windows that the watermark has closed."""
    marks = event_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return session.drained(session.frame_windows(marks), new_folder(spark, "windows"))


@query("s8_growing_source", "select user_id, count(*) as n from events group by user_id")
def growing_source(spark, sf):
    """What a growing source has so far, read as an append stream."""
    rows = session.drained(event_stream(spark, sf).select("event_id", "user_id"), new_folder(spark, "live"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"))
