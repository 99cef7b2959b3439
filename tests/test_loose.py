import os

from gutterline.sources import archive, loose


def entries(spark, *rows):
    return spark.createDataFrame([(b, n, bytearray(d)) for b, n, d in rows], "book string, name string, data binary")


def stamps(folder):
    return {n: (os.stat(f"{folder}/{n}").st_ino, os.stat(f"{folder}/{n}").st_mtime_ns) for n in os.listdir(folder) if n.endswith(".cbz")}


FIRST = [("a", "2.png", b"two"), ("a", "10.png", b"ten"), ("b", "1.png", b"one"), ("c d", "x.png", b"")]


def test_a_second_write_touches_nothing(spark, tmp_path):
    path, rows = f"file://{tmp_path}/books", entries(spark, *FIRST)
    assert sorted(r.book for r in loose.write_changed(rows, path).collect()) == ["a", "b", "c d"]
    before = stamps(tmp_path / "books")
    assert loose.write_changed(entries(spark, *reversed(FIRST)), path).collect() == [] and stamps(tmp_path / "books") == before
    again = entries(spark, ("b", "1.png", b"ONE"), ("e", "1.png", b"new"))
    assert sorted(r.book for r in loose.write_changed(again, path).collect()) == ["b", "e"]
    after = stamps(tmp_path / "books")
    assert {n for n in after if after[n] != before.get(n)} == {"b.cbz", "e.cbz"}
    assert sorted((r.book, r.name, bytes(r.data)) for r in archive.read_books(spark, path).collect()) == sorted([*FIRST[:2], FIRST[3], ("b", "1.png", b"ONE"), ("e", "1.png", b"new")])
    assert loose.write_changed(rows.where("false"), path).collect() == []  # nothing is asked, nothing goes
    assert sorted(r.book for r in loose.write_changed(rows, path).collect()) == ["b"]


def test_a_write_that_failed_is_made_good(spark, tmp_path):
    """Without its digests a version doesn't count."""
    path = f"file://{tmp_path}/books"
    loose.write_changed(entries(spark, *FIRST), path)
    os.remove(tmp_path / "books" / "_digests" / "1" / "_SUCCESS")
    assert sorted(r.book for r in loose.write_changed(entries(spark, *FIRST), path).collect()) == ["a", "b", "c d"]
    assert loose.write_changed(entries(spark, *FIRST), path).collect() == []


def test_files_in_natural_order(spark, tmp_path):
    path = f"file://{tmp_path}/files"
    assert loose.write_files(entries(spark, *FIRST, ("a", "notes.txt", b"-"), ("a", "page 1.jpg", b"p"), ("a+%20b", "1+%41.png", b"q")), path) == 7
    rows = loose.read_files(spark, path).orderBy("book", "place").collect()
    assert [(r.book, r.name, r.place, r.size, bytes(r.data)) for r in rows] == [("a", "2.png", 0, 3, b"two"), ("a", "10.png", 1, 3, b"ten"), ("a", "page 1.jpg", 2, 1, b"p"), ("a+%20b", "1+%41.png", 0, 1, b"q"), ("b", "1.png", 0, 3, b"one")]  # an empty file is passed over
