"""Queries over conversations and events: beats, series, windows, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import store, timeline
from .inputs import micro, micro_sql, table
from .registry import query


def dialogue(spark: SparkSession, sf: str) -> DataFrame:
    """(panel, ord, ink) from conversations: a panel for each, a balloon for each turn."""
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("panel"), F.col("turn").alias("ord"), (F.coalesce(F.length("text"), F.lit(0)) * 160 / 160_000_000.0).alias("ink"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, key, t, tag, value): t in whole microseconds."""
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").alias("tag"), "value")


EVENTS = "ev as (select event_id, user_id as key, epoch_us(ts) as t, event_type as tag, value from events)"
BEATS = """timed as (select conv_id as panel, row_number() over p as seq, cast(floor(least(greatest(cast(250 as double) + coalesce(length(text), 0) * 160 / cast(160000000 as double) * cast(160000 as double), cast(250 as double)), cast(1600 as double)) + cast(0.5 as double)) as bigint) as read, turn as ord from conversations window p as (partition by conv_id order by turn)),
placed as (select *, 450 + coalesce(sum(300 + read) over (partition by panel order by ord rows between unbounded preceding and 1 preceding), 0) as t from timed),
beats as (select panel, seq, cast(t as bigint) as t, cast(300 as bigint) as ms, cast(0 as bigint) as hold, 'reveal' as kind from placed
 union all select panel, 0, 0, 450, 0, 'enter' from placed group by panel
 union all select panel, max(seq) + 1, cast(max(t + 300 + read) as bigint), 0, 600, 'rest' from placed group by panel)"""


@query("w2_dialogue_timeline", f"with {BEATS} select * from beats")
def dialogue_timeline(spark, sf):
    return timeline.beats(dialogue(spark, sf))


@query("a13_frame_duration", f"with {BEATS} select panel, max(t + ms + hold) as duration_ms from beats group by panel")
def frame_duration(spark, sf):
    return timeline.durations(timeline.beats(dialogue(spark, sf)), 2200)


@query("w3_read_ms", "select conv_id, turn, cast(floor(least(greatest(cast(250 as double) + coalesce(length(text), 0) * 160 / cast(160000000 as double) * cast(160000 as double), cast(250 as double)), cast(1600 as double)) + cast(0.5 as double)) as bigint) as read_ms from conversations")
def read_ms(spark, sf):
    return dialogue(spark, sf).select(F.col("panel").alias("conv_id"), F.col("ord").alias("turn"), timeline.read_ms(F.col("ink")).alias("read_ms"))


@query("p10_play_time", f"with {BEATS} select panel, {micro_sql('case when count(*) filter (kind = $$reveal$$) > 0 then cast(1.9 as double) * max(t + ms + hold) + 1400 else 2200 end').replace('$$', chr(39))} as play_us from beats group by panel")
def play_time(spark, sf):
    per = timeline.beats(dialogue(spark, sf)).groupBy("panel").agg(F.max(F.col("t") + F.col("ms") + F.col("hold")).alias("d"), F.count_if(F.col("kind") == "reveal").alias("reveals"))
    return per.select("panel", micro(F.when(F.col("reveals") > 0, 1.9 * F.col("d") + 1400).otherwise(2200.0)).alias("play_us"))


@query(
    "w14_cumulative_timeline",
    f"with {BEATS}, d as (select panel, max(t + ms + hold) as d from beats group by panel), s as (select panel, panel // 50 as chapter, d, coalesce(sum(d) over (partition by panel // 50 order by panel rows between unbounded preceding and 1 preceding), 0) as starts from d) select chapter, b.panel, b.seq, cast(starts + b.t as bigint) as t, b.kind from beats b join s on s.panel = b.panel",
)
def cumulative_timeline(spark, sf):
    all_beats = timeline.beats(dialogue(spark, sf))
    ends = timeline.durations(all_beats, 2200).withColumn("chapter", F.floor(F.col("panel") / 50))
    so_far = Window.partitionBy("chapter").orderBy("panel").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.withColumn("starts", F.coalesce(F.sum("duration_ms").over(so_far), F.lit(0).cast("long")))
    return all_beats.join(starts, "panel").select("chapter", "panel", "seq", (F.col("starts") + F.col("t")).alias("t"), "kind")


_SERIES = f"with {EVENTS}, s as (select key, row_number() over (partition by key order by t, event_id) - 1 as i, t, count(*) over (partition by key) as total, tag, value from ev)"


def _series(spark, sf):
    order = Window.partitionBy("key").orderBy("t", "event_id")
    return events(spark, sf).withColumn("i", (F.row_number().over(order) - 1).cast("long")).withColumn("total", F.count("*").over(Window.partitionBy("key")))


@query("w4_eta", f"{_SERIES} select key, i, case when i > 0 then cast(floor((t - coalesce(lag(t, 5) over k, first_value(t) over k)) * (total - i - 1) / cast(least(i, 5) as double)) as bigint) end as left_us from s window k as (partition by key order by i)")
def eta(spark, sf):
    return timeline.eta(_series(spark, sf))


@query(
    "w5_direction",
    f"{_SERIES}, m as (select key, i, sign(cast(floor(value) as bigint) % 7 - lag(cast(floor(value) as bigint) % 7) over (partition by key order by i)) as step from s) select key, i, cast(coalesce(last_value(nullif(step, 0) ignore nulls) over (partition by key order by i rows between unbounded preceding and current row), 1) as int) as direction from m",
)
def direction(spark, sf):
    return timeline.directions(_series(spark, sf).withColumn("place", F.floor("value") % 7))


@query("w8_stage_spans", f"with {EVENTS} select key, t, tag, lead(t) over (partition by key order by t) - t as span from ev")
def stage_spans(spark, sf):
    return timeline.spans(events(spark, sf))


_MINUTE = 60_000_000


@query("r8_janks", f"with {EVENTS}, g as (select key, t, t - lag(t) over (partition by key order by t) as gap from ev) select key, t, gap from g where gap >= {5 * _MINUTE} and gap < {600 * _MINUTE}")
def janks(spark, sf):
    return timeline.janks(events(spark, sf).select("key", "t"), 5 * _MINUTE, 600 * _MINUTE)


@query(
    "j15_lookback",
    f"with {EVENTS}, g as (select key, t, t - lag(t) over (partition by key order by t) as gap from ev), j as (select * from g where gap >= {5 * _MINUTE} and gap < {600 * _MINUTE}) select j.key, j.t, j.gap, m.t as mark_t, m.tag from j join ev m on m.key = j.key and m.t <= j.t and m.t >= j.t - j.gap - {60 * _MINUTE}",
)
def lookback(spark, sf):
    rows = events(spark, sf)
    return timeline.looked_back(timeline.janks(rows.select("key", "t"), 5 * _MINUTE, 600 * _MINUTE), rows, 60 * _MINUTE)


_WINDOWS = "select cast(floor(epoch_us(ts) / cast(10000000 as double)) as bigint) * 10 as start_s, count(*) as marks, count(*) filter (event_type = 'error') as errors, max(cast(floor(value * cast(1000 as double)) as bigint)) as worst from events group by 1"


@query("r7_windows", _WINDOWS)
def windows(spark, sf):
    ts = F.col("ts").cast("timestamp")
    counted = table(spark, sf, "events").groupBy(F.window(ts, "10 seconds").alias("w")).agg(F.count("*").alias("marks"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max(F.floor(F.col("value") * 1000)).alias("worst"))
    return counted.select(F.unix_seconds("w.start").alias("start_s"), "marks", "errors", "worst")


@query("a3_order_stats", f"with {EVENTS}, r as (select tag, value, row_number() over (partition by tag order by value) - 1 as place, count(*) over (partition by tag) as n from ev) select tag, value as median, n from r where place = n // 2")
def order_stats(spark, sf):
    return timeline.upper_median(events(spark, sf), "tag", "value")


@query("a4_model_timing", f"with {EVENTS} select key, count(*) as runs, min(value) as fastest, max(value) as slowest, cast(floor(sum(cast(floor(value * cast(1000 as double)) as bigint)) / cast(count(*) as double) + cast(0.5 as double)) as bigint) as mean_thousandths from ev group by key")
def model_timing(spark, sf):
    return events(spark, sf).groupBy("key").agg(F.count("*").alias("runs"), F.min("value").alias("fastest"), F.max("value").alias("slowest"), F.floor(F.sum(F.floor(F.col("value") * 1000)) / F.count("*") + 0.5).alias("mean_thousandths"))


@query("a5_stage_timing", f"with {EVENTS}, g as (select tag, lead(t) over (partition by key order by t) - t as span from ev) select tag, count(span) as n, cast(floor(cast(sum(span) as double) / count(span) / 1000 + cast(0.5 as double)) as bigint) as mean_ms from g where span is not null group by tag")
def stage_timing(spark, sf):
    spans = timeline.spans(events(spark, sf)).where("span is not null")
    return spans.groupBy("tag").agg(F.count("span").alias("n"), F.floor(F.sum("span").cast("double") / F.count("span") / 1000 + 0.5).alias("mean_ms"))


@query("r12_progress", f"with {EVENTS}, r as (select *, row_number() over (partition by key order by t desc, event_id desc) as n from ev) select key, event_id, t, tag from r where n = 1 and tag <> 'error'")
def progress(spark, sf):
    return store.latest(events(spark, sf), "key", "t", "event_id", deleted=F.col("tag") == "error").select("key", "event_id", "t", "tag")


@query("r12_toggled_quotes", f"with {EVENTS} select key, tag, count(*) as toggles from ev group by key, tag having count(*) % 2 = 1")
def toggled_quotes(spark, sf):
    return store.toggled(events(spark, sf), "key", "tag")


@query("o8_lru", f"with {EVENTS}, l as (select key, max(t) as t from ev group by key) select key, t from l order by t desc, key desc limit 60")
def lru(spark, sf):
    return store.newest(events(spark, sf).groupBy("key").agg(F.max("t").alias("t")), 60, "t", "key")


@query("s17_shelf_keep", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n <= 3")
def shelf_keep(spark, sf):
    return store.newest(table(spark, sf, "orders"), 3, "o_orderdate", "o_orderkey", by="o_custkey").select("o_custkey", "o_orderkey")


@query("o9_ring_buffer", f"with {EVENTS} select key, event_id from (select *, row_number() over (partition by key order by t desc, event_id desc) as n from ev) where n <= 12")
def ring_buffer(spark, sf):
    return store.newest(events(spark, sf), 12, "t", "event_id", by="key").select("key", "event_id")


@query("s13_prefix", "with p as (select distinct o_custkey, o_orderkey % 40 as place from orders), r as (select *, row_number() over (partition by o_custkey order by place) - 1 as n from p) select o_custkey, place from r where n = place")
def prefix(spark, sf):
    places = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 40).alias("place")).distinct()
    return store.prefix(places, "o_custkey", "place")


@query("r16_running_max", f"with {EVENTS} select key, event_id, least(max(value / cast(100 as double)) over (partition by key order by t rows between unbounded preceding and current row), cast(1 as double)) as done from ev")
def running_max(spark, sf):
    return store.running_max(events(spark, sf).withColumn("done", F.col("value") / 100), "key", "t", "done").select("key", "event_id", "done")


@query("r14_newest_response", f"with {EVENTS} select key, tag, max(event_id) as event_id from ev group by key, tag")
def newest_response(spark, sf):
    return events(spark, sf).groupBy("key", "tag").agg(F.max("event_id").alias("event_id"))


@query(
    "w6_first_run",
    f"{_SERIES}, a as (select key, i, tag, case when tag is not distinct from lag(tag) over (partition by key order by i) then 0 else 1 end as s from s), b as (select *, sum(s) over (partition by key order by i) as run from a), c as (select *, min(run) over (partition by key, tag) as lowest from b) select key, i, tag from c where run = lowest",
)
def first_run(spark, sf):
    return store.first_run(_series(spark, sf), "key", "i", "tag").select("key", "i", "tag")


@query("w13_look_ahead", f"{_SERIES} select key, i, array_to_string(list_sort(list_distinct(list(tag) over (partition by key order by i rows between 1 following and 8 following))), ',') as ahead from s")
def look_ahead(spark, sf):
    rows = store.ahead(_series(spark, sf), "key", "i", "tag", 8)
    return rows.select("key", "i", F.when(F.size("ahead") > 0, F.array_join("ahead", ",")).alias("ahead"))


@query("w15_reading_progress", f"{_SERIES} select key, i, {micro_sql('case when total > 1 then i / cast(total - 1 as double) else 1 end')} as share from s")
def reading_progress(spark, sf):
    return _series(spark, sf).select("key", "i", micro(F.when(F.col("total") > 1, F.col("i") / (F.col("total") - 1)).otherwise(1.0)).alias("share"))


@query("a15_position_in_page", "select conv_id, turn, row_number() over (partition by conv_id order by turn) as place, count(*) over (partition by conv_id) as total from conversations")
def position_in_page(spark, sf):
    page = Window.partitionBy("conv_id")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(page.orderBy("turn")).cast("long").alias("place"), F.count("*").over(page).alias("total"))


@query("a20_reaction_groups", f"with {EVENTS}, k as (select * from (values (1, 'view'), (2, 'click'), (3, 'purchase'), (4, 'signup'), (5, 'error'), (6, 'other')) v(place, tag)) select k.place, k.tag, count(*) as n, count(distinct key) as keys from ev join k on k.tag = ev.tag group by k.place, k.tag")
def reaction_groups(spark, sf):
    kinds = spark.createDataFrame(list(enumerate(["view", "click", "purchase", "signup", "error", "other"], 1)), "place int, tag string")
    return events(spark, sf).join(F.broadcast(kinds), "tag").groupBy("place", "tag").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@query("a21_distinct_layers", f"{_SERIES} select key, tag, min(i) as first_place, max_by(value, i) as last_value from s group by key, tag")
def distinct_layers(spark, sf):
    return _series(spark, sf).groupBy("key", "tag").agg(F.min("i").alias("first_place"), F.max_by("value", "i").alias("last_value"))


@query("j13_quotes_of_layers", f"with {EVENTS}, q as (select key, tag from ev group by key, tag having count(*) % 2 = 1), l as (select key, tag, max_by(value, t) as value from ev group by key, tag) select q.key, q.tag, l.value from q join l on l.key = q.key and l.tag = q.tag")
def quotes_of_layers(spark, sf):
    rows = events(spark, sf)
    return store.toggled(rows, "key", "tag").drop("toggles").join(rows.groupBy("key", "tag").agg(F.max_by("value", "t").alias("value")), ["key", "tag"])


@query("j17_thumb_lookup", "select c.conv_id, c.turn, coalesce(l.quality, -1) as quality from conversations c left join labels l on l.doc_id = c.conv_id")
def thumb_lookup(spark, sf):
    turns, labels = table(spark, sf, "conversations"), table(spark, sf, "labels")
    return turns.join(labels, turns.conv_id == labels.doc_id, "left").select("conv_id", "turn", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("r19_first_reveals", f"{_SERIES}, p as (select *, i // 10 as visit from s) select key, visit, tag, min(i) as i from p group by key, visit, tag")
def first_reveals(spark, sf):
    return _series(spark, sf).withColumn("visit", F.floor(F.col("i") / 10)).groupBy("key", "visit", "tag").agg(F.min("i").alias("i"))


@query("r21_ease_out", f"with {EVENTS} select event_id, {micro_sql('1 - (1 - least(value / cast(100 as double), 1)) * (1 - least(value / cast(100 as double), 1))')} as shown from ev")
def ease_out(spark, sf):
    left = 1 - F.least(F.col("value") / 100, F.lit(1.0))
    return events(spark, sf).select("event_id", micro(1 - left * left).alias("shown"))


@query("r18_mood_clock", f"with {EVENTS}, moods as (select * from (values ('view', cast(1 as double), cast(1 as double)), ('click', cast(0.6 as double), cast(1.2 as double)), ('purchase', cast(1.4 as double), cast(0.85 as double)), ('error', cast(0 as double), cast(1.1 as double))) m(tag, fx, pace)) select event_id, cast(greatest(floor(value * fx), 120) as bigint) as ms, {micro_sql('value / pace')} as clock from ev join moods on moods.tag = ev.tag where fx > 0")
def mood_clock(spark, sf):
    moods = spark.createDataFrame([("view", 1.0, 1.0), ("click", 0.6, 1.2), ("purchase", 1.4, 0.85), ("error", 0.0, 1.1)], "tag string, fx double, pace double")
    rows = events(spark, sf).join(F.broadcast(moods), "tag").where("fx > 0")
    return rows.select("event_id", F.greatest(F.floor(F.col("value") * F.col("fx")), F.lit(120)).cast("long").alias("ms"), micro(F.col("value") / F.col("pace")).alias("clock"))


@query("f17_out_of_reach", f"{_SERIES} select key, i, tag from s where not (i between total // 2 - 2 and total // 2 + 5)")
def out_of_reach(spark, sf):
    centre = F.floor(F.col("total") / 2)
    return _series(spark, sf).where(~F.col("i").between(centre - 2, centre + 5)).select("key", "i", "tag")


@query("f19_gestures", f"with {EVENTS} select event_id, case when value < 35 and t % 1000 < 350 then 'flick' when value > 60 and t % 1000 < 600 then 'swipe' when t % 1000 >= 280 then 'hold' else 'tap' end as gesture from ev")
def gestures(spark, sf):
    ms = F.col("t") % 1000
    kind = F.when((F.col("value") < 35) & (ms < 350), "flick").when((F.col("value") > 60) & (ms < 600), "swipe").when(ms >= 280, "hold").otherwise("tap")
    return events(spark, sf).select("event_id", kind.alias("gesture"))
