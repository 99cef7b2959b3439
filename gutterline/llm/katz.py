"""Operator 5: language-model scores by Katz backoff.

A word model of order ``ORDER``, or any other.  Counts are discounted by
Good-Turing; the weight of a backoff is what the discounts free, over what the
lower order gives to words unseen in the context, so every distribution sums
to one.  A token's probability is found order by order, the lower one first.

Texts are packed into blocks of tokens: the sorted 64-bit hashes of a block's
words and, for each token, its place among them.  Blocks ask, and at the same
time tell, tables that are partitioned by hash: a block sends each n-gram of
its own once, with its count in training texts; a partition sums and answers
every block in the order in which it was asked.  So an n-gram that is in every
text costs a row for each block, wherever it is frequent, and nothing is
joined token by token.  Each order takes a round for its counts, and each but
the first one for the sums that its contexts' backoff weights need.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of an n-gram at most.
ORDER = 2
#: Tokens of a block, and tokens for each partition of a table.  Both bound a
#: task's memory; blocks times partitions is the number of messages of a round.
BLOCK_TOKENS, PARTITION_TOKENS = 600_000, 4_000_000
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Words that a worker keeps the hash of.
KEPT_WORDS = 500_000
#: What stands for the end of a text, and for the context before its first
#: word: odd, as no word's hash is.
END, START = np.uint64(1), np.uint64(3)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word) & ~1  # odd ones are no words
        if len(word) < 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value
        return value


def token_hashes(raw: bytes, hashes: dict) -> np.ndarray:
    """Words of a UTF-8 text, A-Z lower-cased, parted by ASCII white space,
    and then the end."""
    words = raw.lower().split()
    return np.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), END)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + second
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


@dataclass
class Block:
    """Texts of a block: for each token its word's place in ``vocabulary``."""

    vocabulary: np.ndarray
    stream: np.ndarray
    lengths: np.ndarray
    held: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Block:
        return cls(unpacked(row["vocabulary"], "<u8"), unpacked(row["stream"], "<u4"), np.frombuffer(row["lengths"], "<i8"), np.frombuffer(row["held"], "u1").astype(bool))

    def training(self) -> np.ndarray:
        """Which tokens are in training texts."""
        return np.repeat(~self.held, self.lengths)

    def starts(self) -> np.ndarray:
        """The first token of each text."""
        return np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def before(self, values: np.ndarray, at_start) -> np.ndarray:
        """What stands before each token of its text; ``at_start`` before the first."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts()] = at_start
        return out

    def hashes(self, order: int) -> np.ndarray:
        """The hash of the n-gram that ends at each token."""
        words = self.vocabulary[self.stream]
        return words if order == 1 else pair_hash(self.contexts(order), words)

    def contexts(self, order: int) -> np.ndarray:
        """The hash of what stands before each token in its n-gram."""
        return self.before(self.hashes(order - 1), START)

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the distinct n-grams, where each token's is among
        them, and a token of each."""
        if order == 1:
            first = np.empty(len(self.vocabulary), np.int64)
            first[self.stream] = np.arange(len(self.stream))
            return self.vocabulary, self.stream, first
        keys, first, inverse = np.unique(self.hashes(order), return_index=True, return_inverse=True)
        return keys, inverse, first


def blocks(docs: DataFrame, held: Column) -> DataFrame:
    """Texts as rows of blocks; a text stays whole, a null one is empty."""

    def pack(batches):
        hashes, number = _WordHashes(), 0
        ids: list = []
        marks: list[bool] = []
        tokens: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in tokens], np.int64)
            all_tokens = np.concatenate(tokens)
            vocabulary = np.unique(all_tokens)
            values = {
                "block": pa.array([TaskContext.get().partitionId() << 24 | number], pa.int64()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                "n_tokens": pa.array([int(lengths.sum())], pa.int64()),
                "n_training": pa.array([marks.count(False)], pa.int64()),
                "held": pa.array([np.array(marks, "u1").tobytes()], pa.binary()),
                "lengths": pa.array([lengths.astype("<i8").tobytes()], pa.binary()),
                "vocabulary": pa.array([packed(vocabulary.astype("<u8"))], pa.binary()),
                "stream": pa.array([packed(np.searchsorted(vocabulary, all_tokens).astype("<u4"))], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(values)

        size = 0
        for batch in batches:
            for doc_id, mark, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.text_bytes(batch.column(2)), strict=True):
                ids.append(doc_id)
                marks.append(mark)
                tokens.append(token_hashes(raw, hashes))
                size += len(tokens[-1])
                if size >= BLOCK_TOKENS:
                    yield block()
                    number, size = number + 1, 0
                    ids, marks, tokens = [], [], []
        if ids:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), "text")
    return rows.mapInArrow(pack, "block long, doc_ids array<long>, n_tokens long, n_training long, held binary, lengths binary, vocabulary binary, stream binary")


def sliced(keys: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """Which part of sorted ``keys`` belongs to each partition, by top bits."""
    edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    ends = [*edges[1:].tolist(), len(keys)]
    return [(n, slice(a, b)) for n, (a, b) in enumerate(zip(edges.tolist(), ends, strict=True)) if b > a]


def packed(values: np.ndarray) -> bytes:
    """Numbers as byte planes: the high bytes repeat, and compress, so that
    totals can be wide; those of a block alone fit 32 bits."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T).tobytes()


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


MESSAGE = "part int, block long, keys binary, a binary, b binary, c binary"


def messages(block: int, keys: np.ndarray, bits: int, **values: np.ndarray) -> pa.RecordBatch:
    parts = sliced(keys, bits)
    columns = {"part": pa.array([n for n, _ in parts], pa.int32()), "block": pa.array([block] * len(parts), pa.int64()), "keys": pa.array([packed(keys[s]) for _, s in parts], pa.binary())}
    for name in "abc":
        columns[name] = pa.array([packed(values[name][s]) if name in values else None for _, s in parts], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


ANSWER = "part int, block long, answer binary"


def answers(table: pa.Table, whole: np.ndarray, lengths: list[int], extra: bytes | None = None) -> pa.Table:
    """``whole`` cut into an answer for each message; ``extra`` is one more, for block -1."""
    ends = np.cumsum(lengths)
    rows = [packed(whole[e - n : e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
    part = table.column("part")[0].as_py()
    blocks = table.column("block").to_pylist()
    if extra is not None:
        rows, blocks = [*rows, extra], [*blocks, -1]
    return pa.table({"part": pa.array([part] * len(rows), pa.int32()), "block": pa.array(blocks, pa.int64()), "answer": pa.array(rows, pa.binary())})


def received(table: pa.Table, **kinds: str) -> tuple[np.ndarray, list[int], dict[str, np.ndarray]]:
    keys = [unpacked(k, "<u8") for k in table.column("keys").to_pylist()]
    values = {name: np.concatenate([unpacked(v, kind) for v in table.column(name).to_pylist()]) for name, kind in kinds.items()}
    return np.concatenate(keys), [len(k) for k in keys], values


def count_of_counts(totals: np.ndarray) -> bytes:
    """Number of n-grams, sum of counts, and how many have each count up to DISCOUNTED + 1."""
    n = np.bincount(np.minimum(totals, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
    return np.array([(totals > 0).sum(), totals.sum(), *n[1 : DISCOUNTED + 2]], "<i8").tobytes()


def sum_counts(table: pa.Table) -> pa.Table:
    """A partition of the n-grams: twice the count over all blocks, and one
    more for the one block that is to account for the n-gram."""
    keys, lengths, values = received(table, a="<u4")
    of = np.repeat(np.array(table.column("block").to_pylist(), np.int64), lengths)
    _, inverse = np.unique(keys, return_inverse=True)
    totals = np.bincount(inverse, values["a"]).astype(np.int64)
    owner = np.full(len(totals), np.iinfo(np.int64).max)
    np.minimum.at(owner, inverse, of)
    mine = (of == owner[inverse]) & (totals[inverse] > 0)
    return answers(table, (totals[inverse] << 1 | mine).astype("<u8"), lengths, count_of_counts(totals))


def sum_contexts(table: pa.Table) -> pa.Table:
    """A partition of the contexts: the weight of each one's backoff.

    a: discounted counts of what follows, b: what the lower order gives to
    that, c: the context's count.  A context whose counts are all too large to
    be discounted frees nothing; its count is taken as one more, and its
    weight is given with a minus sign to say so.
    """
    keys, lengths, values = received(table, a="<f8", b="<f8", c="<u8")
    _, inverse = np.unique(keys, return_inverse=True)
    count = np.zeros(inverse.max(initial=-1) + 1)
    count[inverse] = values["c"]
    kept, below = np.bincount(inverse, values["a"]), np.bincount(inverse, values["b"])
    full = (count > 0) & (kept > count * (1 - 1e-9))
    free = 1 - kept / np.maximum(count + full, 1)
    weight = np.where(count > 0, free / np.maximum(1 - below, 1e-12), 1.0) * np.where(full, -1, 1)
    return answers(table, weight[inverse].astype("<f8"), lengths)


@dataclass
class Discounts:
    """What remains of a count from 1 to DISCOUNTED."""

    ratio: np.ndarray

    @classmethod
    def good_turing(cls, n: list[int]) -> Discounts:
        """From the numbers of n-grams of count 1, 2, ...; a count whose
        Good-Turing ratio isn't within (0, 1) loses a half instead."""
        ratio = np.ones(DISCOUNTED + 1)
        last = (DISCOUNTED + 1) * n[DISCOUNTED] / n[0] if n[0] else 1.0
        for r in range(1, DISCOUNTED + 1):
            turing = (r + 1) * n[r] / n[r - 1] / r if n[r - 1] else 0.0
            d = (turing - last) / (1 - last) if last < 1 else 0.0
            ratio[r] = d if 0 < d < 1 else (r - 0.5) / r
        return cls(ratio)

    def counts(self, r: np.ndarray) -> np.ndarray:
        return r * np.where(r <= DISCOUNTED, self.ratio[np.minimum(r, DISCOUNTED)], 1.0)


@dataclass
class Unigrams:
    """The lower order: discounted counts, and what is left for unknown words."""

    discounts: Discounts
    total: int
    distinct: int
    unknown: float

    @classmethod
    def of(cls, stats: np.ndarray) -> Unigrams:
        distinct, total, *n = stats.tolist()
        discounts = Discounts.good_turing(n)
        freed = sum(r * k * (1 - discounts.ratio[r]) for r, k in enumerate(n[:DISCOUNTED], 1))
        return cls(discounts, total, distinct, freed / total if freed > 0 else 1.0 / (total + 1))

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discounts.counts(c) / max(self.total, 1), self.unknown)


def exchanged(asked: DataFrame, answer, name: str) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Send messages to their partitions; the answers, block by block, the
    table that has them, and the sum of the partitions' statistics."""
    out = common.stored(asked.groupBy("part").applyInArrow(answer, ANSWER), name)
    stats = [np.frombuffer(r.answer, "<i8") for r in out.where("block = -1").select("answer").toLocalIterator()]
    by_block = out.where("block >= 0").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "answer"))).alias(name))
    return by_block, out, np.sum(stats, axis=0) if stats else np.zeros(DISCOUNTED + 3, np.int64)


def joined(parts: list[dict], kind: str) -> np.ndarray:
    return np.concatenate([unpacked(p["answer"], kind) for p in parts]) if parts else np.zeros(0, kind)


def scored(docs: DataFrame, held: Column, order: int = ORDER) -> DataFrame:
    """Scores of all documents by a model of those that aren't held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score.  A null or empty text is its end alone; repeated rows count as
    often as they stand; null ids pass through; other columns are not read;
    with no training text every word is unknown.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    # bucketed, so that answers are dealt to the blocks and blocks stay where they are
    folder, buckets = common.new_folder(spark, "blocks"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = f"blocks_{uuid.uuid4().hex}"
    blocks(docs, held).write.option("compression", "zstd").option("path", folder).bucketBy(buckets, "block").saveAsTable(store, format="parquet")
    texts = spark.table(store)
    texts.stored_in = folder
    tokens = texts.agg(F.sum("n_tokens")).first()[0]
    rows_before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # a row is a block
    try:
        if not tokens:
            return spark.createDataFrame([], SCORES)
        return _scored(texts, max(6, math.ceil(math.log2(max(1, tokens / PARTITION_TOKENS)))), order)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_before)
        spark.sql(f"drop table {store}")
        common.released(texts)


@dataclass
class Evaluated:
    """What a block's answers say of its tokens, up to some order: each
    n-gram's count, and its probability by recursion from the words on."""

    counts: list[np.ndarray]
    marks: list[np.ndarray]
    p: list[np.ndarray]

    @classmethod
    def of(cls, block: Block, row: dict, orders: int, unigrams: Unigrams, discounts: list[Discounts], texts: int) -> Evaluated:
        """``discounts`` are those of order 2 and on, ``texts`` the number of training texts."""
        out = cls([], [], [])
        for n in range(1, orders + 1):
            answer = joined(row[f"counts{n}"], "<u8").astype(np.int64)
            _, inverse, _ = block.grams(n)
            out.marks.append(answer & 1)
            out.counts.append((answer >> 1)[inverse])
        out.p.append(unigrams.probability(out.counts[0]))
        for n in range(2, orders + 1):
            if f"weights{n}" not in row:
                break
            weight = joined(row[f"weights{n}"], "<f8")[np.unique(block.contexts(n), return_inverse=True)[1]]
            r, of_context = out.counts[n - 1], out.of_contexts(block, n, texts)
            own = discounts[n - 2].counts(r) / np.maximum(of_context + (weight < 0), 1)
            out.p.append(np.where(r > 0, own, np.abs(weight) * out.p[-1]))
        return out

    def of_contexts(self, block: Block, order: int, texts: int) -> np.ndarray:
        """How often each token's context is followed by something in
        training: a text's start as often as there are texts."""
        return block.before(self.counts[order - 2], texts)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(texts: DataFrame, bits: int, order: int) -> DataFrame:
    lean = texts.select("block", "held", "lengths", "vocabulary", "stream")

    def tell_counts(n: int):
        def tell(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block.read(row)
                    keys, inverse, _ = block.grams(n)
                    counts = np.bincount(inverse[block.training()], minlength=len(keys))
                    yield messages(row["block"], keys, bits, a=counts.astype("<u4"))

        return tell

    counted, stats, tables = lean.select("block"), [], []
    for n in range(1, order + 1):
        answered, out, of_table = exchanged(lean.mapInArrow(tell_counts(n), MESSAGE), sum_counts, f"counts{n}")
        counted = counted.join(answered, "block")
        stats.append(of_table)
        tables.append(out)
    answered = common.stored(counted, "answers")
    common.released(*tables)
    unigrams, discounts = Unigrams.of(stats[0]), [Discounts.good_turing(s.tolist()[2:]) for s in stats[1:]]
    n_texts = int(texts.agg(F.sum("n_training")).first()[0])

    def tell_weights(n: int):
        def tell(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block.read(row)
                    known = Evaluated.of(block, row, n, unigrams, discounts, n_texts)
                    _, _, first = block.grams(n)
                    own = first[known.marks[n - 1] == 1]
                    keys, context = np.unique(block.contexts(n), return_inverse=True)
                    kept = np.bincount(context[own], discounts[n - 2].counts(known.counts[n - 1][own]), len(keys))
                    below = np.bincount(context[own], known.p[n - 2][own], len(keys))
                    total = np.zeros(len(keys), np.int64)
                    total[context] = known.of_contexts(block, n, n_texts)
                    yield messages(row["block"], keys, bits, a=kept.astype("<f8"), b=below.astype("<f8"), c=total.astype("<u8"))

        return tell

    full = answered
    for n in range(2, order + 1):
        weights, _, _ = exchanged(lean.join(full, "block").mapInArrow(tell_weights(n), MESSAGE), sum_contexts, f"weights{n}")
        full = full.join(weights, "block")

    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                known = Evaluated.of(block, row, order, unigrams, discounts, n_texts)
                c, starts = known.counts[0], block.starts()
                base = np.log10((c + 1) / (unigrams.total + unigrams.distinct + 1))
                sums = lambda x: np.add.reduceat(x, starts)  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(block.held), pa.array(block.lengths), pa.array(sums((c > 0).astype(np.int64))), pa.array(np.full(len(starts), unigrams.total)), pa.array(sums(base)), pa.array(sums(np.log10(known.p[order - 1])))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return common.stored(texts.drop("n_tokens", "n_training").join(full, "block").mapInArrow(score, SCORES), "scores")


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 7 == 2, F.lit(False))
