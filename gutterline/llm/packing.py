"""Operator 6: packing documents into sequences by cutting-stock column generation.

Each document is cut into full sequences and a remainder.  How often each
length of remainder occurs is a histogram of at most ``capacity`` counts;
``cutting_stock`` covers it by patterns, which are given to the ranked
remainders of each length.  What no pattern takes forms one stream that is cut
at every sequence's end, so that only its last sequence is padded.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, cutting_stock, tokenizing

CAPACITY = 1024
#: Bits of a sequence id below the number of the task.
TASK_BITS = 40


def is_power_of_two(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


@dataclass
class Plan:
    """Rows of pattern use (length, first rank, copies, sequences, first
    sequence, offset); for each length, the first rank of the stream and its
    place there; the first sequence of the stream; and how many tokens the
    linear program's patterns, the other patterns and the stream hold."""

    uses: list[tuple[int, int, int, int, int, int]]
    stream: list[tuple[int, int, int]]
    first_stream_sequence: int
    tokens: tuple[int, int, int]


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Lay out whole patterns one after another, and what they leave as a stream."""
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    taken = np.zeros(len(lengths), np.int64)
    uses, sequence, tokens = [], 0, []
    for found in cutting_stock.whole_solution(lengths, demand, capacity):
        before = int(taken @ lengths)
        for pattern, times in found:
            offset = 0
            for k, n in pattern.items():
                uses.append((int(lengths[k]), int(taken[k]), n, times, sequence, offset))
                taken[k] += n * times
                offset += n * int(lengths[k])
            sequence += times
        tokens.append(int(taken @ lengths) - before)
    stream, place = [], 0
    for n, of_it, done in zip(lengths.tolist(), demand.tolist(), taken.tolist(), strict=True):
        stream.append((n, done, place))
        place += (of_it - done) * n
    return Plan(uses, stream, sequence, (*tokens, place))


def _local(spark: SparkSession, rows: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """Rows of longs as a local table; as Python rows they would be read by workers of their own."""
    columns = np.array(rows, np.int64).reshape(-1, len(names)).T
    return spark.createDataFrame(pa.table([pa.array(np.ascontiguousarray(c)) for c in columns], names=names))


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Per document: doc_id, doc_tokens, the task that read it, how many full
    pieces and how many remainders of the same length the task had before it,
    the crc of each full piece and of the remainder, and the remainder's ids
    (little-endian 32-bit)."""
    common.small_batches(docs.sparkSession)

    def encode(batches):
        encoder, end = tokenizing.byte_encoder(tokenizer_path, "<u4"), end_id.to_bytes(4, "little")
        size, task = 4 * capacity, TaskContext.get().partitionId()
        pieces, ranks = 0, [0] * capacity
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for ids in encoder.texts(batch.column(1)):
                ids += end
                full = [zlib.crc32(ids[a : a + size]) for a in range(0, len(ids) - size + 1, size)]
                rest = ids[len(full) * size :]
                for column, value in zip(columns, (len(ids) // 4, task, pieces, ranks[len(rest) // 4], full, zlib.crc32(rest), rest), strict=True):
                    column.append(value)
                pieces += len(full)
                ranks[len(rest) // 4] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=["doc_id", "doc_tokens", "task", "pieces", "rank", "full_crc", "rest_crc", "rest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(encode, "doc_id long, doc_tokens long, task int, pieces long, rank long, full_crc array<long>, rest_crc long, rest binary")


def packed(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns one row for each piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.  Sequences of remainders are numbered
    from 0; those of full pieces have the task that read them in the bits
    from ``TASK_BITS`` on, so that they are numbered without a shuffle.

    A null or empty text is its end id alone; repeated rows and null ids are
    documents of their own; other columns are not read; an empty table gives
    no pieces.
    """
    spark = docs.sparkSession
    done = common.stored(tokenised(docs, tokenizer_path, end_id, capacity), "tokens").withColumn("rest_length", F.col("doc_tokens") % capacity)

    first = F.shiftleft(F.col("task").cast("long") + 1, TASK_BITS) + F.col("pieces")
    whole = done.select("doc_id", "doc_tokens", first.alias("first"), F.posexplode("full_crc").alias("i", "ids_crc32")).select(
        "doc_id", (F.col("i") * capacity).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

    # remainders: ranked within their length over all tasks, then placed by the plan's arithmetic
    counts = done.where("rest_length > 0").groupBy("task", "rest_length").agg(F.count("*").alias("n"))
    plan = packing_plan({r.rest_length: r.n for r in counts.groupBy("rest_length").agg(F.sum("n").alias("n")).collect()}, capacity)  # capacity - 1 rows at most
    before = Window.partitionBy("rest_length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "rest_length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_base"))
    uses = _local(spark, plan.uses, ["rest_length", "rank_from", "copies", "times", "sequence", "place"])
    stream = _local(spark, plan.stream, ["rest_length", "stream_from", "stream_place"])
    # both are bounded by the lengths that there are, not by the documents
    uses_of = uses.groupBy("rest_length").agg(F.array_sort(F.collect_list(F.struct("rank_from", "copies", "times", "sequence", "place"))).alias("uses"))
    rest = done.where("rest_length > 0").select("doc_id", "doc_tokens", "task", "rest_length", "rank", "rest_crc", "rest")
    ranked = rest.join(bases, ["task", "rest_length"]).withColumn("rank", F.col("rank") + F.col("rank_base"))
    placed = ranked.join(F.broadcast(stream), "rest_length").join(F.broadcast(uses_of), "rest_length", "left")
    use = F.element_at(F.filter("uses", lambda u: (u.rank_from <= F.col("rank")) & (F.col("rank") < u.rank_from + u.copies * u.times)), 1)
    placed = placed.withColumn("use", F.when(F.col("rank") < F.col("stream_from"), use))
    nth = F.col("rank") - F.col("use.rank_from")
    at = F.col("stream_place") + (F.col("rank") - F.col("stream_from")) * F.col("rest_length")
    placed = placed.withColumn("at", at).withColumn("room", capacity - F.col("at") % capacity)
    piece = lambda start, length, sequence, offset: F.struct(start.cast("long").alias("from"), length.cast("long").alias("length"), sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
    zero, size = F.lit(0), F.col("rest_length")
    stream_sequence = F.floor(F.col("at") / capacity) + plan.first_stream_sequence
    pieces = (
        F.when(F.col("use").isNotNull(), F.array(piece(zero, size, F.col("use.sequence") + F.floor(nth / F.col("use.copies")), F.col("use.place") + nth % F.col("use.copies") * size)))
        .when(size <= F.col("room"), F.array(piece(zero, size, stream_sequence, F.col("at") % capacity)))
        .otherwise(F.array(piece(zero, F.col("room"), stream_sequence, F.col("at") % capacity), piece(F.col("room"), size - F.col("room"), stream_sequence + 1, zero)))
    )
    part = F.substring("rest", (F.col("p.from") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    cut = placed.select("doc_id", "doc_tokens", "rest_length", "rest_crc", "rest", F.explode(pieces).alias("p")).select(
        "doc_id", (F.col("doc_tokens") - size + F.col("p.from")).alias("start"), F.col("p.length").alias("length"),
        F.when(F.col("p.length") == size, F.col("rest_crc")).otherwise(F.crc32(part)).alias("ids_crc32"),
        "doc_tokens", F.col("p.sequence_id").alias("sequence_id"), F.col("p.offset").alias("offset"),
    )
    return whole.unionByName(cut)
