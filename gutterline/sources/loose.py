"""Loose page files, and a sink that rewrites only the archives that changed."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from . import archive


def write_files(entries: DataFrame, path: str) -> int:
    """(book, name, data) to a file for each entry, in a folder for each book;
    how many there are.  A file takes its name when it is whole, so a task
    that runs again changes nothing."""
    base = archive.local(path)

    def write(batches):
        for batch in batches:
            for book, name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = os.path.join(base, book)
                os.makedirs(folder, exist_ok=True)
                own = os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(own, "wb") as file:
                    file.write(data or b"")
                os.replace(own, os.path.join(folder, name))
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    rows = entries.select(F.col("book").cast("string"), F.col("name").cast("string"), F.col("data").cast("binary"))
    return rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """book (the folder), name, place (from 0, in natural order), size and data
    of the pages among the files below ``path``; junk and other files are left
    out, and so are empty files, which Spark's reader passes over.  Without
    ``data`` among the columns asked for, files are listed only."""
    parts = F.split("path", "/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = found.select(F.element_at(parts, -2).alias("book"), F.element_at(parts, -1).alias("name"), F.col("length").alias("size"), F.col("content").alias("data"))
    pages = rows.where(names.is_page(F.col("name"), F.lit(False)))
    place = (F.row_number().over(Window.partitionBy("book").orderBy(names.natural_key(F.col("name")), "name")) - 1).cast("long")
    return pages.select("book", "name", place.alias("place"), "size", "data")


def _versions(path: str) -> list[tuple[int, bool]]:
    """The versions of the digests so far, and whether each is whole."""
    folder = os.path.join(archive.local(path), "_digests")
    return sorted((int(n), os.path.exists(os.path.join(folder, n, "_SUCCESS"))) for n in os.listdir(folder) if n.isdigit()) if os.path.isdir(folder) else []


def book_digests(entries: DataFrame) -> DataFrame:
    """book and a digest of its entries' names and data, in no matter what order."""
    entry = F.struct(F.col("name").cast("string").alias("name"), F.sha2(F.coalesce(F.col("data").cast("binary"), F.lit(b"")), 256).alias("digest"))
    return entries.groupBy(F.col("book").cast("string").alias("book")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(entry))), 256).alias("digest"))


def write_changed(entries: DataFrame, path: str) -> DataFrame:
    """(book, name, data) to an archive for each book whose entries aren't
    those that its archive was written from; returns these books.

    The digests of all books stand beside the archives, a version for each
    call.  They are written last, so a call that fails is made good by the
    next one.  Books that ``entries`` doesn't have keep their archives.
    """
    spark, versions, folder = entries.sparkSession, _versions(path), f"{path}/_digests"
    whole = [v for v, done in versions if done]
    known = spark.read.schema("book string, digest string").parquet(f"{folder}/{whole[-1]}") if whole else spark.createDataFrame([], "book string, digest string")
    merged = book_digests(entries).withColumnRenamed("digest", "own").join(known, "book", "full")
    differs = F.col("own").isNotNull() & ~F.col("own").eqNullSafe(F.col("digest"))
    draft = f"{folder}/draft-{uuid.uuid4().hex}"
    merged.select("book", F.coalesce("own", "digest").alias("digest"), differs.alias("changed")).write.parquet(draft)
    decided = spark.read.schema("book string, digest string, changed boolean").parquet(draft)
    changed = decided.where("changed").select("book")
    if not changed.isEmpty():
        archive.write_books(entries.withColumn("book", F.col("book").cast("string")).join(changed, "book", "left_semi"), path)
    decided.select("book", "digest").write.parquet(f"{folder}/{versions[-1][0] + 1 if versions else 1}")
    return changed
