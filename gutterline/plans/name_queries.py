"""Queries over names and links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as n
from .inputs import table
from .registry import query

_NAME = """case doc_id % 9 when 0 then '__MACOSX/._' || doc_id || '.jpg' when 1 then 'cap' || doc_id % 13 || '/' || doc_id || '.JPG' when 2 then 'cap' || doc_id % 13 || '/page' || doc_id || 'b.png' when 3 then 'ComicInfo.xml'
 when 4 then 'Cap' || doc_id % 7 || '/._' || doc_id || '.webp' when 5 then 'extra/.DS_Store' when 6 then source || '/' || doc_id % 100 || '.jpeg' when 7 then 'Thumbs.db' else 'p' || doc_id || '.b' || doc_id % 5 || '.avif' end"""
ENTRIES = f"entries as (select doc_id, {_NAME} as name, doc_id % 31 = 0 as is_dir from documents)"


def entries(spark, sf):
    """(doc_id, name, is_dir): archive entries with what file managers leave among them."""
    return table(spark, sf, "documents").select("doc_id", F.expr(_NAME).alias("name"), (F.col("doc_id") % 31 == 0).alias("is_dir"))


_JUNK = "(name like '\\_\\_MACOSX/%' escape '\\' or regexp_extract(name, '[^/]*$') like '.\\_%' escape '\\' or regexp_extract(name, '[^/]*$') in ('.DS_Store', 'Thumbs.db'))"
_PAGE = f"(not is_dir and regexp_matches(name, '(?i)\\.(jpe?g|png|webp|gif|avif|bmp)$') and not {_JUNK})"


@query("f1_is_junk", f"with {ENTRIES} select doc_id, name, {_JUNK} as junk from entries")
def is_junk(spark, sf):
    return entries(spark, sf).select("doc_id", "name", n.is_junk(F.col("name")).alias("junk"))


@query("f2_select_pages", f"with {ENTRIES} select doc_id, name from entries where {_PAGE}")
def select_pages(spark, sf):
    return entries(spark, sf).where(n.is_page(F.col("name"), F.col("is_dir"))).select("doc_id", "name")


@query("s11_page_count", f"with {ENTRIES} select doc_id % 13 as book, count(*) filter ({_PAGE}) as pages, count(*) as entries from entries group by 1")
def page_count(spark, sf):
    return entries(spark, sf).groupBy((F.col("doc_id") % 13).alias("book")).agg(F.count_if(n.is_page(F.col("name"), F.col("is_dir"))).alias("pages"), F.count("*").alias("entries"))


_KEY = "array_to_string(list_transform(regexp_extract_all(name, '(\\d+|\\D+)'), lambda r: case when regexp_full_match(r, '[0-9]+') then lpad(r, 20, '0') else lower(r) end), '')"


@query("o3_natural_sort", f"with {ENTRIES}, k as (select doc_id, name, {_KEY} as key, doc_id % 13 as book from entries) select doc_id, key, row_number() over (partition by book order by key, doc_id) as place from k")
def natural_sort(spark, sf):
    rows = entries(spark, sf).select("doc_id", n.natural_key(F.col("name")).alias("key"), (F.col("doc_id") % 13).alias("book"))
    return rows.select("doc_id", "key", F.row_number().over(Window.partitionBy("book").orderBy("key", "doc_id")).cast("long").alias("place"))


@query("f18_page_of_sprite", f"with {ENTRIES} select doc_id, try_cast(nullif(regexp_extract(name, 'p(\\d+)\\.', 1), '') as int) - 1 as page from entries")
def page_of_sprite(spark, sf):
    return entries(spark, sf).select("doc_id", n.page_of_sprite(F.col("name")).alias("page"))


@query("t6_extension", "with u as (select page_id, url, regexp_extract(url, '[^/]*$') as base from pages) select page_id, lower(regexp_extract(base, '\\.([^.]*)$', 1)) as extension, regexp_replace(base, '\\.[^.]*$', '') as stem from u")
def extension(spark, sf):
    return table(spark, sf, "pages").select("page_id", n.extension(F.col("url")).alias("extension"), n.stem(F.col("url")).alias("stem"))


@query("f16_openable", f"with {ENTRIES}, e as (select doc_id, lower(regexp_extract(regexp_extract(name, '[^/]*$'), '\\.([^.]*)$', 1)) as x from entries) select doc_id, x = '' or regexp_matches(x, '^(cbza|cbz|cbr|zip|rar)$') as openable from e")
def openable(spark, sf):
    return entries(spark, sf).select("doc_id", n.openable(F.col("name")).alias("openable"))


_LINK = """case page_id % 7 when 0 then 'https://www.dropbox.com/s/' || page_id || '/book.cbz?dl=0&rlkey=k' || page_id when 1 then 'github.com/user' || page_id % 5 || '/repo/blob/main/dir/b' || page_id || '.cbz'
 when 2 then 'https://drive.google.com/file/d/' || page_id when 3 then '  ' when 4 then 'ftp://host/' || page_id when 5 then ' example.org/a/' || page_id || '.cbz ' else url end"""
_RESOLVED = f"""l as (select page_id, trim({_LINK}) as text from pages), u as (select page_id, text, case when regexp_matches(text, '(?i)^[a-z][a-z0-9+.-]*://') then text else 'https://' || text end as url from l),
 f as (select *, lower(regexp_extract(url, '^([A-Za-z0-9+.-]+)://', 1)) as scheme, lower(regexp_extract(url, '^[^:]+://([^/?#:]+)', 1)) as host, regexp_extract(url, '^[^:]+://[^/?#]+(/[^?#]*)', 1) as path, regexp_extract(url, '\\?([^#]*)', 1) as query from u),
 g as (select *, list_filter(string_split(path, '/'), lambda p: p <> '') as parts, array_to_string(list_filter(string_split(query, '&'), lambda p: not regexp_matches(p, '^(dl|raw)(=|$)') and p <> ''), '&') as kept,
  case when text = '' then 'linkEmpty' when scheme not in ('http', 'https') or host = '' then 'linkInvalid' when host in ('drive.google.com', 'docs.google.com', 'drive.usercontent.google.com') then 'linkDrive' end as error from f)"""


@query(
    "t1_resolve_link",
    f"""with {_RESOLVED} select page_id, error, case when error is not null then null when host in ('www.dropbox.com', 'dropbox.com') then scheme || '://dl.dropboxusercontent.com' || path || case when kept = '' then '' else '?' || kept end
 when host = 'github.com' and len(parts) >= 5 and parts[3] in ('blob', 'raw') then 'https://raw.githubusercontent.com/' || parts[1] || '/' || parts[2] || '/' || array_to_string(parts[4:], '/') else url end as url from g""",
)
def resolve_link(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", n.resolve_link(F.expr(_LINK)).alias("r"))
    return rows.select("page_id", "r.error", "r.url")


_HEADER = "case page_id % 4 when 0 then null when 1 then 'attachment; filename=\"vol ' || page_id || '.cbz\"' when 2 then 'attachment; filename*=UTF-8''''tomo%20' || page_id || '.cbz; filename=plain.cbz' else 'inline' end"


@query("t2_file_name", f"""with h as (select page_id, url, {_HEADER} as d, list_filter(string_split(regexp_extract(url, '^[^:]+://[^/?#]+(/[^?#]*)', 1), '/'), lambda p: p <> '') as parts from pages)
 select page_id, coalesce(case when regexp_extract(d, 'filename\\*\\s*=\\s*(?:UTF-8|utf-8)?''''([^;]+)', 1) <> '' then url_decode(regexp_extract(d, 'filename\\*\\s*=\\s*(?:UTF-8|utf-8)?''''([^;]+)', 1)) end,
 nullif(regexp_extract(d, 'filename\\s*=\\s*"?([^";]+)"?', 1), ''), url_decode(parts[len(parts)]), 'tomo') as name from h""")
def file_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", n.file_name(F.col("url"), F.expr(_HEADER)).alias("name"))


@query("t3_keys", "select doc_id, source || '|' || n_chars as book_key, '12|' || source || '|' || n_chars as versioned, regexp_extract(source || ':' || doc_id || ':x', '^([^:]*):', 1) as head, regexp_extract(source || ':' || doc_id || ':x', '^[^:]*:(.*)$', 1) as tail from documents")
def keys(spark, sf):
    book, panel = F.concat_ws("|", "source", F.col("n_chars").cast("string")), F.concat_ws(":", "source", F.col("doc_id").cast("string"), F.lit("x"))
    return table(spark, sf, "documents").select("doc_id", book.alias("book_key"), F.concat(F.lit("12|"), book).alias("versioned"), F.regexp_extract(panel, "^([^:]*):", 1).alias("head"), F.regexp_extract(panel, "^[^:]*:(.*)$", 1).alias("tail"))


@query("t4_folder_hash", "select doc_id, list_reduce(list_prepend(cast(2166136261 as bigint), list_transform(string_split(source || '|' || doc_id, ''), lambda c: cast(ascii(c) as bigint))), lambda h, c: cast((xor(h, c) * cast(16777619 as hugeint)) & cast(4294967295 as hugeint) as bigint)) as hash from documents")
def folder_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", n.fnv1a(F.concat_ws("|", "source", F.col("doc_id").cast("string"))).alias("hash"))


@query("t5_padded_ids", "select doc_id, 'p' || case when doc_id + 1 < 1000 then lpad(cast(doc_id + 1 as varchar), 3, '0') else cast(doc_id + 1 as varchar) end as page from documents")
def padded_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", n.page_id(F.col("doc_id")).alias("page"))


@query("f15_stale_errors", "select event_id, regexp_matches(case event_id % 5 when 0 then 'ChunkLoadError: x' when 1 then 'Loading chunk a-1 failed' when 2 then 'Failed to fetch' when 3 then 'importing a module script failed' else props end, '(?i)ChunkLoadError|Failed to load chunk|Loading chunk [\\w-]+ failed|Failed to fetch dynamically imported module|Importing a module script failed') as stale from events")
def stale_errors(spark, sf):
    message = F.expr("case event_id % 5 when 0 then 'ChunkLoadError: x' when 1 then 'Loading chunk a-1 failed' when 2 then 'Failed to fetch' when 3 then 'importing a module script failed' else props end")
    return table(spark, sf, "events").select("event_id", n.is_stale(message).alias("stale"))


@query("p18_eta_text", "with m as (select event_id, greatest(cast(floor(value * cast(3000 as double) / 1000 + cast(0.5 as double)) as bigint), 1) as s from events) select event_id, case when s < 60 then s || ' s' else (s // 60) || ' min ' || (s % 60) || ' s' end as eta from m")
def eta_text(spark, sf):
    return table(spark, sf, "events").select("event_id", n.eta_text(F.col("value") * 3000).alias("eta"))


@query("t7_props_json", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def props_json(spark, sf):
    parsed = F.from_json("props", "k long")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"))


@query("a17_distinct_sets", "select source, count(distinct lang) as langs, count(distinct n_chars % 10) as digits from documents group by source")
def distinct_sets(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.countDistinct(F.col("n_chars") % 10).alias("digits"))


@query("u4_set_operations", "select 'both' as part, count(*) as n from (select doc_id from labels intersect select doc_id from documents) union all select 'unlabelled', count(*) from (select doc_id from documents except select doc_id from labels)")
def set_operations(spark, sf):
    labelled, all_ids = table(spark, sf, "labels").select("doc_id"), table(spark, sf, "documents").select("doc_id")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(labelled.intersect(all_ids), "both").union(count(all_ids.subtract(labelled), "unlabelled"))
