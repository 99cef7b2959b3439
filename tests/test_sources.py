import os

from pyspark.sql import functions as F

from gutterline.functions import names
from gutterline.sources import archive, pages


def test_archives(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1.jpg", b"one"), ("a", "2.jpg", b""), ("b", "x.png", b"three")], "book string, name string, data binary")
    path = f"file://{tmp_path}/books"
    archive.write_books(rows, path)
    assert sorted(os.listdir(tmp_path / "books")) == ["a.cbz", "b.cbz"]
    assert sorted((r.book, r.name, r.size, bytes(r.data)) for r in archive.read_books(spark, path).collect()) == [("a", "1.jpg", 3, b"one"), ("a", "2.jpg", 0, b""), ("b", "x.png", 5, b"three")]
    assert sorted((r.name, r.size) for r in archive.listed(spark, path).collect()) == [("1.jpg", 3), ("2.jpg", 0), ("x.png", 5)]
    assert [bytes(r.data) for r in archive.read_books(spark, path).where("name = 'x.png'").collect()] == [b"three"]


def test_stored_page(spark):
    header = F.struct(F.lit(7).cast("long").alias("index"), F.lit("ñ").alias("id"), F.lit(3).cast("long").alias("size"))
    row = spark.range(1).select(pages.encoded(header, F.lit(b"\x00\xff\x01")).alias("p")).select(pages.decoded(F.col("p")).alias("d"), pages.is_rar(F.col("p")).alias("rar")).first()
    assert (row.d.header["index"], row.d.header.id, bytes(row.d.body), row.rar) == (7, "ñ", b"\x00\xff\x01", False)


def test_manifest_checks(spark):
    good = '{"version":1,"pages":[{"id":"p1","size":[1,2],"panels":[{"id":"k","ord":0,"conf":0.5,"bbox":[1,2,3,4]}]}]}'
    bad = good.replace("[1,2,3,4]", "[1,2]").replace('"ord":0', '"ord":-1')
    rows = spark.createDataFrame([(good,), (bad,), ("no",), ('{"version":2,"pages":[]}',), (None,)], "t string").select(pages.parsed_manifest(F.col("t")).alias("m"))
    found = rows.select(pages.problems(F.col("m")).alias("p"), F.col("m.pages")[0]["panels"][0]["tension"].alias("tension")).collect()
    assert [r.p for r in found] == [[], ["badBox", "badOrder"], ["notAManifest"], ["notAManifest"], ["notAManifest"]] and found[0].tension == 0.0


def test_names(spark):
    cases = ["p10.JPG", "p9.jpg", "__MACOSX/p1.jpg", "a/._b.png", "Thumbs.db", "x/.DS_Store", "note.txt"]
    rows = spark.createDataFrame([(c,) for c in cases], "n string")
    assert [r[0] for r in rows.where(names.is_page(F.col("n"), F.lit(False))).orderBy(names.natural_key(F.col("n"))).collect()] == ["p9.jpg", "p10.JPG"]
    row = spark.range(1).select(names.fnv1a(F.lit("abc")).alias("h"), names.folder_name(F.lit("abc")).alias("f"), names.page_id(F.lit(1233)).alias("p"), names.page_of_sprite(F.lit("p012.b3.png")).alias("s")).first()
    assert (row.h, row.f, row.p, row.s) == (440920331, "t7aigaz", "p1234", 11)


def test_links(spark):
    cases = {
        "https://www.dropbox.com/s/a/b.cbz?rlkey=k&dl=0": ("https://dl.dropboxusercontent.com/s/a/b.cbz?rlkey=k", None),
        "github.com/u/r/blob/main/d/f.cbz": ("https://raw.githubusercontent.com/u/r/main/d/f.cbz", None),
        "https://drive.google.com/x": (None, "linkDrive"), " ": (None, "linkEmpty"), "ftp://h/x": (None, "linkInvalid"), "example.org/a.cbz": ("https://example.org/a.cbz", None),
    }
    rows = spark.createDataFrame([(c,) for c in cases], "u string").select("u", names.resolve_link(F.col("u")).alias("r"))
    assert {r.u: (r.r.url, r.r.error) for r in rows.collect()} == cases
    named = lambda url, d: spark.range(1).select(names.file_name(F.lit(url), F.lit(d).cast("string"))).first()[0]
    assert named("https://h/a/b%20c.cbz?x=1", None) == "b c.cbz"
    assert named("https://h/a", "attachment; filename*=UTF-8''%C3%B1.cbz; filename=x.cbz") == "ñ.cbz"
    assert named("https://h/a", "attachment; filename*=UTF-8''%ZZ; filename=\"x.cbz\"") == "x.cbz"
    assert named("https://h/", None) == "tomo"


def test_long_digit_runs_and_characters_beyond_the_first_plane(spark):
    digits = ["1" + "0" * 20, "9" * 20, "00000000000000000000000007", "8", "2" + "0" * 25]
    rows = spark.createDataFrame([(f"p{d}.png",) for d in digits], "n string")
    assert [r[0] for r in rows.orderBy(names.natural_key(F.col("n"))).collect()] == [f"p{d}.png" for d in sorted(digits, key=int)]
    text, h = "aé\U0001f600", 2166136261
    raw = text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[i : i + 2], "big")) * 16777619 % 2**32
    assert [r[0] for r in spark.createDataFrame([(text,), ("",), (None,)], "n string").select(names.fnv1a(F.col("n"))).collect()] == [h, 2166136261, None]
