"""Stored pages: a length, a JSON header and the bytes of the page, in one
binary column; and manifests as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = "struct<index:bigint,id:string,size:bigint>"
MANIFEST = "struct<version:int,pages:array<struct<id:string,size:array<double>,panels:array<struct<id:string,ord:int,conf:double,bbox:array<double>,tension:double>>>>>"


def encoded(header: Column, body: Column) -> Column:
    """Unsigned 32-bit big-endian length of the header, the header, the body."""
    raw = F.encode(F.to_json(header), "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 8, "0")), raw, body)


def decoded(page: Column) -> Column:
    """A struct of the header's fields and the body."""
    length = F.conv(F.hex(F.substring(page, 1, 4)), 16, 10).cast("int")
    header = F.from_json(F.decode(F.substr(page, F.lit(5), length), "UTF-8"), HEADER)
    return F.struct(header.alias("header"), F.substr(page, length + 5).alias("body"))


def is_rar(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 6)) == "526172211A07"


def parsed_manifest(text: Column, strict: bool = False) -> Column:
    """A manifest with its defaults; null (or, if ``strict``, an error) where
    the text is none."""
    value = F.from_json(text, MANIFEST, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    panel = lambda p: F.struct(p.id.alias("id"), p.ord.alias("ord"), p.conf.alias("conf"), p.bbox.alias("bbox"), F.coalesce(p.tension, F.lit(0.0)).alias("tension"))
    page = lambda p: F.struct(p.id.alias("id"), p["size"].alias("size"), F.transform(p.panels, panel).alias("panels"))
    return F.when(value["version"] == 1, F.struct(value["version"].alias("version"), F.transform(value["pages"], page).alias("pages")))


def problems(manifest: Column) -> Column:
    """What a parsed manifest breaks: codes, empty if it is sound."""
    panels = F.flatten(F.transform(manifest["pages"], lambda p: F.coalesce(p.panels, F.array())))
    bad = lambda test, code: F.when(test, code)
    codes = F.array(
        bad(manifest.isNull(), "notAManifest"),
        bad(F.exists(panels, lambda p: F.size(p.bbox) != 4), "badBox"),
        bad(F.exists(panels, lambda p: (p.ord < 0) | p.ord.isNull()), "badOrder"),
        bad(F.exists(panels, lambda p: ~p.tension.between(0.0, 1.0)), "badTension"),
    )
    return F.array_compact(codes)


def manifests(panels: DataFrame, book: Column, size: tuple[int, int]) -> DataFrame:
    """One JSON manifest for each book from (page_id, det_id, place, x, y, w, h, conf)."""
    box = F.array(*(F.col(c).cast("double") for c in "xywh"))
    one = F.struct("place", F.struct(F.format_string("%d.k%d", "page_id", "place").alias("id"), F.col("place").cast("int").alias("ord"), F.col("conf"), box.alias("bbox")).alias("p"))
    pages = panels.groupBy(book.alias("book"), "page_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda e: e.p).alias("panels"))
    page = F.struct("page_id", F.struct(F.format_string("%d", "page_id").alias("id"), F.array(*(F.lit(float(v)) for v in size)).alias("size"), "panels").alias("p"))
    whole = pages.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(page)), lambda e: e.p).alias("pages"))
    return whole.select("book", F.to_json(F.struct(F.lit(1).alias("version"), "pages")).alias("manifest"))
