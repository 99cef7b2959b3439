"""Comic archives as a data source: one partition for each archive.

``spark.read.format("cbz").load(folder)`` gives book, name, size, data.
Without ``data`` among the columns of the schema, entries are listed and not
inflated; a filter on ``name`` is pushed into the archive and inflates only
that entry.  Writing makes one archive for each value of ``book``; rows must
be dealt by book (``write_books`` does that).
"""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "book string, name string, size long, data binary"


def local(path: str) -> str:
    """The path on the shared file system that ``path`` names."""
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"archives need a mounted file system, not {path}")
    return unquote(parsed.path) if parsed.scheme else path


class _Archive(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str) -> None:
        self.columns, self.path, self.names = schema.names, local(path), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",) and self.names is None:
                self.names = {f.value}
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            return [_Archive(self.path)]
        return [_Archive(os.path.join(d, n)) for d, _, names in sorted(os.walk(self.path)) for n in sorted(names) if n.endswith((".cbz", ".cbza", ".zip"))]

    def read(self, partition: _Archive) -> Iterator[tuple]:
        book = os.path.splitext(os.path.basename(partition.path))[0]
        with zipfile.ZipFile(partition.path) as archive:
            for entry in archive.infolist():
                if entry.is_dir() or self.names is not None and entry.filename not in self.names:
                    continue
                data = archive.read(entry) if "data" in self.columns else None
                values = {"book": book, "name": entry.filename, "size": entry.file_size, "data": data}
                yield tuple(values[c] for c in self.columns)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


class ArchiveWriter(DataSourceWriter):
    """Each task writes its books under names of its own; they take their
    place when all tasks have ended."""

    def __init__(self, path: str) -> None:
        self.path = local(path)

    def write(self, rows: Iterator) -> _Written:
        os.makedirs(self.path, exist_ok=True)
        archives: dict[str, tuple[str, zipfile.ZipFile]] = {}
        try:
            for row in rows:
                if row.book not in archives:
                    own = os.path.join(self.path, f".{uuid.uuid4().hex}")
                    archives[row.book] = (own, zipfile.ZipFile(own, "w", zipfile.ZIP_STORED))
                entry = zipfile.ZipInfo(row.name)
                archives[row.book][1].writestr(entry, bytes(row.data or b""))
        finally:
            for _, archive in archives.values():
                archive.close()
        return _Written([(own, os.path.join(self.path, f"{book}.cbz")) for book, (own, _) in archives.items()])

    def commit(self, messages: list[_Written | None]) -> None:
        for message in messages:
            for own, final in message.files if message else []:
                os.replace(own, final)

    def abort(self, messages: list[_Written | None]) -> None:
        for message in messages:
            for own, _ in message.files if message else []:
                if os.path.exists(own):
                    os.remove(own)


class ComicArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cbz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ComicArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_books(entries: DataFrame, path: str) -> None:
    """(book, name, data) to one archive for each book, entries by name."""
    register(entries.sparkSession)
    rows = entries.select(F.col("book").cast("string").alias("book"), F.col("name").cast("string").alias("name"), F.length("data").cast("long").alias("size"), F.col("data").cast("binary").alias("data"))
    rows.repartition("book").sortWithinPartitions("book", "name").write.format("cbz").mode("append").option("path", path).save()


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes, without inflating."""
    register(spark)
    return spark.read.format("cbz").schema("book string, name string, size long").load(path)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("cbz").load(path)


def kind_of(content: Column) -> Column:
    """``rar`` or ``zip`` by a file's first bytes, else null."""
    head = F.hex(F.substring(content, 1, 6))
    return F.when(head == "526172211A07", "rar").when(head.startswith("504B0304"), "zip")
