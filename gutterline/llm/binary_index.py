"""Operator 4: token ids as raw binary shards with a minimal perfect hash index.

Documents are dealt by ranges of their id; each range becomes shard files in
ascending id order, as many as keep a shard small.  A shard holds the raw ids, the keys in order, and an
index: a minimal perfect hash takes a key to its slot, where the first id,
the number of ids and a fingerprint of the key are stored, so that one
document is found in constant time and a foreign key is refused.

File format (little-endian): magic ``TIDX0001``; 8 unsigned 64-bit numbers
(bytes per id, documents, ids, levels of the hash, and four zeros); the size
of each level as unsigned 64-bit; the bit words of each level (64 bits each);
per slot: start (u64), length (u64), fingerprint (u32); per document in order:
key (i64), occurrence of the key (u32), is-null flag (u8); the ids.
"""

from __future__ import annotations

import io
import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokenizing

MAGIC = b"TIDX0001"
#: Documents and ids of a shard at most (a longer document is a shard alone),
#: documents of a range, about, and ranges that are summed up together.
DOCS_PER_SHARD, IDS_PER_SHARD, DOCS_PER_RANGE, RANGES_PER_GROUP = 2048, 4_000_000, 4096, 1024
#: Bits of a level of the hash for each key that is left.
SPREAD = 2.0


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser (xor, shift, multiply) of ``x`` under ``seed``."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def key_hash(keys: np.ndarray, occurrence: np.ndarray, null: np.ndarray) -> np.ndarray:
    """A document's key: its id, which of the rows with this id it is, and
    whether the id is null."""
    return mixed(mixed(keys.astype(np.int64).view(np.uint64), 1) + occurrence.astype(np.uint64), 2) ^ mixed(null.astype(np.uint64), 3)


class PerfectHash:
    """Minimal perfect hash: each level keeps the keys that are alone in
    their bit; a key's slot is the rank of its bit."""

    def __init__(self, sizes: list[int], words: list[np.ndarray]) -> None:
        self.sizes, self.words = sizes, words
        self.bits = [np.unpackbits(w.view(np.uint8), bitorder="little").astype(bool) for w in words]
        self.ranks = [np.concatenate([[0], np.cumsum(b)]) for b in self.bits]

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys of a shard have the same 64-bit hash")
        sizes, words, left = [], [], hashes
        while len(left):
            size = max(64, math.ceil(SPREAD * len(left) / 64) * 64)
            at = (mixed(left, 100 + len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(sizes, words)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each key; a foreign key gets any slot, or -1."""
        out, base, left = np.full(len(hashes), -1, np.int64), 0, np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            at = (mixed(hashes[left], 100 + level) % np.uint64(size)).astype(np.int64)
            here = self.bits[level][at]
            out[left[here]] = base + self.ranks[level][at[here]]
            left, base = left[~here], base + int(self.ranks[level][-1])
        return out


def packed_shard(keys: np.ndarray, null: np.ndarray, lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    """The bytes of one shard; rows in ascending order of key, null first."""
    same = np.concatenate([[False], (keys[1:] == keys[:-1]) & (null[1:] == null[:-1])]) if len(keys) else np.zeros(0, bool)
    row = np.arange(len(keys))
    occurrence = row - np.maximum.accumulate(np.where(same, 0, row)) if len(keys) else row
    hashes = key_hash(keys, occurrence, null)
    index = PerfectHash.build(hashes)
    slots, starts = index.slots(hashes), np.concatenate([[0], np.cumsum(lengths)])[:-1]
    by_slot = np.argsort(slots)
    out = io.BytesIO()
    out.write(MAGIC)
    out.write(np.array([width, len(keys), int(lengths.sum()), len(index.sizes), 0, 0, 0, 0], "<u8").tobytes())
    out.write(np.array(index.sizes, "<u8").tobytes())
    for words in index.words:
        out.write(words.astype("<u8").tobytes())
    for values, kind in ((starts[by_slot], "<u8"), (lengths[by_slot], "<u8"), (hashes[by_slot] >> np.uint64(32), "<u4"), (keys, "<i8"), (occurrence, "<u4"), (null, "u1")):
        out.write(values.astype(kind).tobytes())
    out.write(ids)
    return out.getvalue()


class Shard:
    """Keyed access to the bytes of a shard."""

    def __init__(self, content: bytes) -> None:
        if content[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.content, self.at = content, 8
        self.width, docs, self.n_ids, levels, *_ = (int(x) for x in self._take("<u8", 8))
        sizes = [int(x) for x in self._take("<u8", levels)]
        self.index = PerfectHash(sizes, [self._take("<u8", s // 64) for s in sizes])
        self.start, self.length, self.print = self._take("<u8", docs), self._take("<u8", docs), self._take("<u4", docs)
        self.keys, self.occurrence, self.null = self._take("<i8", docs), self._take("<u4", docs), self._take("u1", docs)
        self.ids = self._take(f"<u{self.width}", self.n_ids)

    def _take(self, kind: str, n: int) -> np.ndarray:
        values = np.frombuffer(self.content, kind, n, self.at)
        self.at += values.nbytes
        return values

    def find(self, keys: np.ndarray, occurrence: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each key's ids; -1 and 0 where there is no such key."""
        hashes = key_hash(keys, occurrence, null)
        slots = self.index.slots(hashes)
        if not len(self.print):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        found = (slots >= 0) & (self.print[slots] == (hashes >> np.uint64(32)).astype(np.uint32))
        return np.where(found, self.start[slots].astype(np.int64), -1), np.where(found, self.length[slots].astype(np.int64), 0)

    def document(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of one document, or None."""
        start, length = self.find(np.array([doc_id or 0]), np.array([occurrence]), np.array([doc_id is None], np.uint8))
        return None if start[0] < 0 else self.ids[start[0] : start[0] + length[0]]


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, docs_per_shard: int = DOCS_PER_SHARD, docs_per_range: int = DOCS_PER_RANGE) -> DataFrame:
    """Encode whole texts and write shard files, range of ids by range of ids.

    Returns the manifest: range, shard, n_docs, n_ids; a row for each file.
    Null texts are empty (the end id alone); null ids come first; rows with
    the same id stay apart, in the order of a digest of their texts, as
    occurrences 0, 1, ... of it within a shard; other columns are not read.  A
    shard is written under a name of its own and then renamed: a task that is
    run again replaces it with the same bytes.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    ranges = max(1, math.ceil(docs.select("doc_id").count() / docs_per_range))
    # digest and row part the rows of one id, so that it may span ranges
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("row"), "text")
    dealt = keyed.repartitionByRange(ranges, "doc_id", "digest", "row").sortWithinPartitions("doc_id", "digest", "row").select("doc_id", "text")

    def write(batches):
        width = 2 if tokenizing.library(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
        encode, end = tokenizing.word_encoder(tokenizer_path, f"<u{width}"), end_id.to_bytes(width, "little")
        number, shard = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        ids: list[bytes] = []

        def flush() -> pa.RecordBatch:
            lengths, null = np.array([len(x) // width for x in ids], np.int64), np.array([k is None for k in keys], np.uint8)
            content = packed_shard(np.array([k or 0 for k in keys], np.int64), null, lengths, b"".join(ids), width)
            files, path = pyarrow.fs.FileSystem.from_uri(folder)
            files.create_dir(path, recursive=True)
            own = f"{path}/.{uuid.uuid4().hex}"
            with files.open_output_stream(own) as out:
                out.write(content)
            files.move(own, f"{path}/{number:08d}-{shard:08d}.tidx")
            row = {"range": pa.array([number], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([int(lengths.sum())], pa.int64())}
            return pa.RecordBatch.from_pydict(row)

        size = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = encode(text or "") + end
                if ids and (len(ids) == docs_per_shard or size + len(new) // width > IDS_PER_SHARD):
                    yield flush()
                    shard, size, keys, ids = shard + 1, 0, [], []
                keys.append(key)
                ids.append(new)
                size += len(new) // width
        if ids:
            yield flush()

    return common.stored(dealt.mapInArrow(write, "range int, shard int, n_docs long, n_ids long"), "manifest")


def ids_before(manifest: DataFrame) -> DataFrame:
    """range, shard, before: ids of all shards before each one, summed up
    within ranges, groups of ranges, and over the groups."""
    earlier = lambda column, *by: F.coalesce(F.sum(column).over((Window.partitionBy(*by[:-1]) if by[:-1] else Window).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    group = F.floor(F.col("range") / RANGES_PER_GROUP)
    ranges = manifest.groupBy("range").agg(F.sum("n_ids").alias("n")).withColumn("group", group)
    groups = ranges.groupBy("group").agg(F.sum("n").alias("n")).select("group", earlier("n", "group").alias("of_groups"))
    bases = ranges.withColumn("of_ranges", earlier("n", "group", "range")).join(groups, "group").select("range", (F.col("of_ranges") + F.col("of_groups")).alias("base"))
    return manifest.withColumn("own", earlier("n_ids", "range", "shard")).join(bases, "range").select("range", "shard", (F.col("own") + F.col("base")).alias("before"))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Read shard files back, each document through the index.

    Returns doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, range, shard; raises where a key isn't found.
    """
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.tidx").load(folder)

    def read(batches):
        for batch in batches:
            for place, shard, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = Shard(content)
                start, length = own.find(own.keys, own.occurrence, own.null)
                if (start < 0).any():
                    raise ValueError(f"shard {place}-{shard}: a key is missing from the index")
                crc = [zlib.crc32(own.ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(start.tolist(), length.tolist(), strict=True)]
                keys = pa.array(own.keys, pa.int64(), mask=own.null.astype(bool))
                names = (pa.array(np.full(len(start), x, np.int32)) for x in (place, shard))
                yield pa.RecordBatch.from_arrays([keys, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), *names], names=["doc_id", "start", "n_tokens", "ids_crc32", "range", "shard"])

    numbered = files.select(*(F.regexp_extract("path", r"(\d+)-(\d+)\.tidx$", i).cast("int").alias(n) for i, n in enumerate(("range", "shard"), 1)), "content")
    found = numbered.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, range int, shard int")
    return found.join(ids_before(manifest), ["range", "shard"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "range", "shard")


def indexed_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to shard files in the shared folder and read them back.
    An empty table makes no file and gives no row."""
    spark = docs.sparkSession
    folder = common.new_folder(spark, "shards")
    manifest = write_shards(docs, folder, tokenizer_path, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, range int, shard int")
    return read_shards(manifest, folder)
