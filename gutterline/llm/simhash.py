"""Operator 8: SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint takes the majority of each bit over the hashes of all word
shingles.  Each of the 64 positions carries a non-zero vector of radius + 1
bits; table v drops the positions whose vector is orthogonal to v.  Up to
``radius`` differing positions never span the whole space, so some v is
orthogonal to all of them and the pair meets in table v: no link is lost.

Distinct fingerprints alone are compared, so exact copies cost nothing.  A
table's bucket of two is compared by Spark, a bucket of up to
``LARGE_BUCKET`` in one task that emits a star for each component in it.  The
members of larger buckets emit every value within half the radius: two
fingerprints link if and only if they share such a value, and no value can
have more neighbours than the ball has points.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Buckets with more distinct fingerprints than this are not compared in one task.
LARGE_BUCKET = 1024


def shingle_hashes(raw: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``size`` words of a UTF-8 text, repeats included;
    of all words if there are fewer; none for a text without words.  A-Z are
    lower-cased; words are parted by ASCII white space."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 for none."""
    counts = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[part : part + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0]) if len(hashes) else 0


def fingerprint_of(text: Column, size: int = SHINGLE) -> Column:
    """The 64-bit fingerprint of a text column, over shingles of ``size``
    words, as a long; a null text is empty: 0."""

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array([majority(shingle_hashes(raw, size)) for raw in common.text_bytes(texts)], pa.int64())

    return fingerprints(text)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks as signed 64-bit integers; position i carries vector i mod (2^(radius+1) - 1) + 1."""
    vectors = 2 ** (radius + 1) - 1
    masks = [sum(1 << i for i in range(bits) if (i % vectors + 1 & v).bit_count() % 2 == 1) for v in range(1, vectors + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def stars(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a bucket's components: its smallest member with each other one."""
    left, out = np.sort(members), []
    while len(left):
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            # as unsigned: bits of a negative number would be those of its absolute value
            near = np.bitwise_count((left ^ np.int64(queue.pop())).view(np.uint64)) <= radius
            found = left[near].tolist()
            out += [(root, x) for x in found]
            queue += found
            left = left[~near]
    return out


def half_ball(value: Column, radius: int = RADIUS, bits: int = BITS) -> Column:
    """All values within radius / 2 of ``value``."""
    flips = [sum(1 << i for i in chosen) for n in range(radius // 2 + 1) for chosen in itertools.combinations(range(bits), n)]
    return F.transform(F.lit([m - (1 << 64) if m >> 63 else m for m in flips]), lambda m: value.bitwiseXOR(m.cast("long")))


def links(prints: DataFrame) -> DataFrame:
    """Links (a < b) between the distinct fingerprints of column ``fp`` that
    have the same components as all pairs within the radius."""
    tables = F.array(*[F.struct(F.lit(n).cast("byte").alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for n, m in enumerate(covering_masks())])
    rows = prints.select("fp", F.explode(tables).alias("t")).select("t.v", "t.key", "fp")
    buckets = common.stored(rows.groupBy("v", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "buckets")
    pairs = buckets.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")

    members = rows.join(buckets.where("n > 2").select("v", "key", "n"), ["v", "key"])
    groups = members.where(F.col("n") <= LARGE_BUCKET).groupBy("v", "key").agg(F.collect_list("fp").alias("fps")).select("fps")

    def compare(batches):
        for batch in batches:
            found = [x for fps in batch.column(0) for x in stars(np.array(fps.as_py(), np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    grouped = groups.mapInArrow(compare, "a long, b long")
    large = members.where(F.col("n") > LARGE_BUCKET).select("fp").distinct()
    near = common.stored(large.select("fp", F.explode(half_ball(F.col("fp"))).alias("value")), "half_balls")
    hubs = near.groupBy("value").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    hubbed = near.join(hubs, "value").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return pairs.union(grouped).union(hubbed).distinct()


def _edges(links: DataFrame) -> DataFrame:
    return common.stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")


def _starred(state: DataFrame) -> DataFrame:
    """A large and a small star over edges (u > v); the components stay."""
    both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
    starred = common.stored(small, "edges")
    common.released(state)
    return starred


def contracted(links: DataFrame, rounds: int = 1) -> DataFrame:
    """Links (a, b) with the components of ``links``, after some rounds of stars."""
    state = _edges(links)
    for _ in range(rounds):
        state = _starred(state)
    return state.select(F.col("v").alias("a"), F.col("u").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars.

    ``edges`` has a and b; returns node and root (the smallest node), a row
    for each node that isn't its own root.  Each round is written to the
    shared folder; it ends when a round changes nothing.
    """
    state, before = _edges(edges), None
    while True:
        state = _starred(state)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def classes(marked: DataFrame, id_column: str = "doc_id", linked_by: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """For rows with ``fp`` and an id: fp, component (its smallest
    fingerprint) and component_id (its smallest id, null ids aside);
    ``linked_by`` gives the links between distinct fingerprints."""
    prints = common.stored(marked.groupBy("fp").agg(F.min(id_column).alias("rep")), "prints")
    roots = components(linked_by(prints.select("fp")))
    linked = roots.union(roots.select("root", "root").distinct()).withColumnRenamed("node", "fp")
    joined = prints.join(linked, "fp")
    lowest = joined.groupBy("root").agg(F.min("rep").alias("lowest"))
    near = joined.select("fp", "root").join(lowest, "root")
    return common.stored(prints.join(near, "fp", "left").select("fp", F.coalesce("root", "fp").alias("component"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("lowest")).alias("component_id")), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    Null and empty texts have fingerprint zero and link like any other;
    repeated rows stay; a null id is never a component's id unless the
    component has no other; other columns are not read.
    """
    common.small_batches(docs.sparkSession)
    marked = common.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_of(F.col("text")).alias("fp")), "fingerprints")
    return marked.join(classes(marked), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component: the one of smallest id, with all its
    columns.  Of rows that share that id one stays, and null ids stay only
    where their component has no other."""
    common.small_batches(docs.sparkSession)
    marked = common.stored(docs.select("doc_id", F.xxhash64("text").alias("digest"), fingerprint_of(F.col("text")).alias("fp")), "fingerprints")
    return smallest_ids(docs, marked, classes(marked))


def smallest_ids(docs: DataFrame, marked: DataFrame, grouped: DataFrame) -> DataFrame:
    """The document of smallest id of each component in ``grouped``;
    ``marked`` has doc_id, digest (of the text) and fp of each document."""
    names = {n: common.unused(docs, n) for n in ("first_id", "first_digest", "own_digest")}
    first = marked.join(grouped, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("of")).select(F.col("of.doc_id").alias(names["first_id"]), F.col("of.digest").alias(names["first_digest"]))
    rows = docs.withColumn(names["own_digest"], F.xxhash64("text"))
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col(names["first_id"])) & (F.col(names["own_digest"]) == F.col(names["first_digest"])))
    return kept.dropDuplicates(["doc_id", names["own_digest"]]).select(*[F.col(f"`{c}`") for c in docs.columns])
