"""What the corpus operators share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch that goes to a Python worker; texts can be long.
BATCH_ROWS, BATCH_BYTES = 1000, 64 << 20
#: Whether a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of a Python worker: few rows and bytes in each Arrow
    batch.  The session keeps these settings, since what is built on them runs
    later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it; only where that is unset (a local
    session) a temporary folder takes its place.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and a lost executor costs no more than the reread.  The write's shuffle
    files go when it ends, not when the driver next collects garbage."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_in = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing that is still to run reads them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_in)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: What this Python worker keeps between tasks.
_RESIDENT: dict[Hashable, object] = {}


def resident(key: Hashable, build: Callable[[], object]) -> object:
    """What ``build`` makes, kept for the tasks that follow in this Python
    worker.  One thing is kept: workers outlive stages, so a model or a word
    cache would stay beside the next stage's."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        give_back()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def give_back() -> None:
    """Return freed memory to the system; allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, null as empty, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    for value in column:
        yield value.as_py() or b""


def ids_crc32(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
