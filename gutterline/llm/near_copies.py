"""Near-duplicates by Jaccard similarity of word shingles: operator 8 as a stage.

SimHash fingerprints over the same shingles, met by covering LSH, give the
first candidates (operator 8); each is confirmed on the whole sets.  At a
similarity of 0.8 two fingerprints differ in some ten of 64 bits, beyond any
radius that covering masks can afford, so an exact way follows for the pairs
that these tables don't promise.

A text is the set of its word shingles.  Two sets of similarity t or more
share a shingle among the first n - ceil(t n) + 1 of each, in any order that
is the same for all texts: those prefixes alone are joined, and no pair is
lost.  A sample says which shingles are common; the order puts these last, so
that few texts meet.  The order decides the cost alone, never the result.

Texts that share a prefix shingle are a bucket.  One of its members is
compared with each other one that isn't linked to it yet; then all pairs of a
bucket that these links leave in different components.  What is left out could
only join what is joined already.  Before the first of these a text's root is
the smallest text that one round of stars finds for it: that spares rounds, and
costs one comparison at most of each member of a bucket.  Every link is
confirmed on the whole sets.

Two bounds, both exact, spare most texts the confirmation.  From the first
shared shingle on, enough must be left of both sets.  And a parity sketch (bit
h mod 512 is flipped for each hash h) differs in no more bits than the sets do
in shingles.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE, SIMILARITY = 5, 0.8
#: Distinct texts in the sample, about; texts of it that make a shingle
#: common; common shingles that the order knows.  A passage that one text in
#: ten thousand has should be known: its pairs grow with the square of the input.
SAMPLE, COMMON_FROM, COMMON = 50_000, 3, 100_000
#: Members of a bucket from which it is joined in parts.
LARGE_BUCKET, SALTS = 1024, 256
#: 64-bit words of a parity sketch.
SKETCH = 8


def shingles(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles as sorted hashes."""
    return np.unique(simhash.shingle_hashes(raw, size))


def sketch(own: np.ndarray) -> np.ndarray:
    """Parity of the hashes at each place of the sketch."""
    flipped = np.bincount((own % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(flipped.astype(np.uint8), bitorder="little").view("<i8")


def alike(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sets have that Jaccard similarity; empty sets are equal."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= similarity * (len(x) + len(y) - shared) - 1e-9


def common_shingles(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes that several texts have, and how many of them do."""

    def hashes(batches):
        for batch in batches:
            for raw in common.text_bytes(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(raw, size).view(np.int64))], names=["h"])

    often = texts.select("text").mapInArrow(hashes, "h long").groupBy("h").count().where(F.col("count") >= COMMON_FROM).orderBy(F.desc("count"), "h").limit(COMMON)
    often = common.stored(often, "common")
    counts = often.toArrow()
    common.released(often)
    known = counts.column("h").to_numpy().view(np.uint64)
    order = np.argsort(known)
    return known[order], counts.column("count").to_numpy()[order]


def prefixes(texts: DataFrame, size: int, similarity: float, known: np.ndarray, counts: np.ndarray) -> DataFrame:
    """fp, size of the set, its prefix and sketch of each row of fp and text; an empty set has the prefix 0."""

    def cut(raw: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        own = shingles(raw, size)
        if not len(own):
            return 0, np.zeros(1, np.int64), sketch(own)
        often = np.zeros(len(own), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            often = np.where(known[at] == own, counts[at], 0)
        return len(own), own[np.lexsort((own, often))][: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1].view(np.int64), sketch(own)

    def rows(batches):
        for batch in batches:
            found = [cut(raw) for raw in common.text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int32()), *(pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (1, 2))], names=["fp", "size", "prefix", "bits"])

    return texts.select("fp", "text").mapInArrow(rows, "fp long, size int, prefix array<long>, bits array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are alike.  The texts of a that many
    pairs have are dealt over parts."""

    def compare(batches):
        last, own = None, None
        for batch in batches:
            keep = []
            for a, left, right in zip(batch.column(0).to_pylist(), common.text_bytes(batch.column(2)), common.text_bytes(batch.column(3)), strict=True):
                if a != last:
                    last, own = a, shingles(left, size)
                keep.append(alike(own, shingles(right, size), similarity))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    left = salted.select("a", "salt").distinct().join(texts.select(F.col("fp").alias("a"), F.col("text").alias("ta")), "a")
    both = salted.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("tb")), "b").join(left, ["a", "salt"])
    return both.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long")


def _with_values(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Join on value.  Values that many rows have are joined apart: where they
    turn out few, Spark broadcasts them; where not, it splits their rows."""
    large = rows.join(values.where(F.col("n") > LARGE_BUCKET), "value")
    return large.union(rows.join(values.where(F.col("n") <= LARGE_BUCKET), "value").select(large.columns))


def _sided(members: DataFrame, side: str, *columns) -> DataFrame:
    """``columns``, and what the bounds need of one side of a pair."""
    return members.select(*columns, *(F.col(c).alias(f"{c}_{side}") for c in ("size", "pos", *(f"s{i}" for i in range(SKETCH)))))


def _may_be_alike(similarity: float) -> Column:
    """The bounds on a pair that shares a shingle."""
    total = F.col("size_a") + F.col("size_b")
    enough = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) >= similarity / (1 + similarity) * total - 1e-9
    differing = functools.reduce(operator.add, (F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(SKETCH)))
    return enough & (differing <= (1 - similarity) / (1 + similarity) * total + 1e-9)


def _rooted(links: DataFrame) -> DataFrame:
    """fp and root of each text that ``links`` join to a smaller one."""
    return links.groupBy(F.col("b").alias("fp")).agg(F.min("a").alias("root"))


def simhash_candidates(sims: DataFrame) -> DataFrame:
    """Operator 8 over rows of fp and sim (a text's SimHash): pairs (a < b) of
    texts, one of each fingerprint with the others of it, and one of each of
    two fingerprints that covering LSH links."""
    firsts = common.stored(sims.groupBy("sim").agg(F.min("fp").alias("first")), "firsts")
    same = sims.join(firsts, "sim").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    of = lambda side: firsts.select(F.col("sim").alias(side), F.col("first").alias(f"of_{side}"))
    near = simhash.links(firsts.select(F.col("sim").alias("fp"))).join(of("a"), "a").join(of("b"), "b")
    return same.union(near.select(F.least("of_a", "of_b"), F.greatest("of_a", "of_b")))


def links(texts: DataFrame, sims: DataFrame, prints: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a < b) between distinct texts that have the same components as
    all pairs of that similarity.  ``texts`` has fp and text, ``sims`` each fp
    once with its SimHash, ``prints`` each fp once."""
    candidates = common.stored(simhash_candidates(sims), "candidates")
    ends = candidates.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    ends = common.stored(texts.join(ends, "fp", "left_semi").dropDuplicates(["fp"]), "ends")
    first = common.stored(confirmed(candidates, ends, size, similarity), "first")
    common.released(candidates, ends)
    joined = _rooted(simhash.contracted(first))

    every = max(1, prints.count() // SAMPLE)
    known, counts = common_shingles(texts.where(F.pmod("fp", F.lit(every)) == 0).dropDuplicates(["fp"]), size)
    sets = prefixes(texts, size, similarity, known, counts).dropDuplicates(["fp"]).join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sets = common.stored(sets, "sets")
    rows = sets.select("fp", "size", "root", F.posexplode("prefix").alias("pos", "value"))
    hub = F.min_by(F.struct("fp", "root"), F.xxhash64("value", "fp"))
    mixed = F.min("root") != F.max("root")
    buckets = common.stored(rows.groupBy("value").agg(F.count("*").alias("n"), hub.alias("hub"), mixed.alias("mixed")).where("mixed").select("value", "n", F.col("hub.fp").alias("hub"), F.col("hub.root").alias("hub_root")), "buckets")
    bits = sets.select("fp", *(F.col("bits")[i].alias(f"s{i}") for i in range(SKETCH)))
    members = common.stored(_with_values(rows, buckets).join(bits, "fp"), "members")
    common.released(sets, buckets)
    wanted = common.stored(texts.select("fp", "text").dropDuplicates(["fp"]).join(members.select("fp").distinct(), "fp", "left_semi"), "wanted")
    fits = _may_be_alike(similarity)

    hubs = _sided(members.where("fp = hub"), "a", "value", "n", F.col("fp").alias("a"))
    tried = _with_values(_sided(members.where("root <> hub_root"), "b", "value", F.col("fp").alias("b")), hubs).where(fits)
    tried = common.stored(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried")
    near_links = common.stored(first.union(confirmed(tried, wanted, size, similarity)), "near")
    common.released(first)

    roots = simhash.components(near_links).withColumnRenamed("node", "fp")
    near = roots.select(F.col("root").alias("a"), F.col("fp").alias("b"))
    placed = members.drop("n", "hub", "hub_root", "root").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = placed.groupBy("value").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("value", "n")
    mixed = common.stored(_with_values(placed, mixed), "mixed")
    common.released(members, near_links)
    # in a large bucket only sets of near sizes meet: those of a band, or of bands side by side
    parts, is_large = F.ceil(F.col("n") / LARGE_BUCKET), F.col("n") > LARGE_BUCKET
    band = F.floor(F.log(F.greatest("size", F.lit(1))) / math.log(1 / similarity)).cast("int")
    own, bands = F.when(is_large, band).otherwise(0), F.when(is_large, F.array(band - 1, band, band + 1)).otherwise(F.array(F.lit(0)))
    left = _sided(mixed, "a", "value", F.pmod(F.xxhash64("fp"), parts).alias("salt"), own.alias("band"), F.col("fp").alias("a"), F.col("root").alias("root_a"))
    spread = mixed.withColumn("band", F.explode(bands)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    right = _sided(spread, "b", "value", "salt", "band", F.col("fp").alias("b"), F.col("root").alias("root_b"))
    others = left.join(right, ["value", "salt", "band"]).where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & fits).select("a", "b").distinct()
    others = common.stored(others.join(tried, ["a", "b"], "left_anti"), "others")
    common.released(mixed, tried)
    return near.union(confirmed(others, wanted, size, similarity))


def first_of_each(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component of near copies, as ``simhash.first_of_each``
    keeps it.  Empty and null texts are copies of each other; a text of fewer
    words than a shingle has one, of all its words."""
    common.small_batches(docs.sparkSession)
    print_of = F.xxhash64(F.coalesce("text", F.lit("")))
    marked = common.stored(docs.select("doc_id", F.xxhash64("text").alias("digest"), print_of.alias("fp"), simhash.fingerprint_of(F.col("text"), size).alias("sim")), "fingerprints")
    sims = marked.groupBy("fp").agg(F.min("sim").alias("sim"))
    texts = docs.select(print_of.alias("fp"), "text")
    return simhash.smallest_ids(docs, marked.drop("sim"), simhash.classes(marked, linked_by=lambda prints: links(texts, sims, prints, size, similarity)))
