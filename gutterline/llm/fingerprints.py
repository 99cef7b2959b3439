"""Operator 7: document fingerprints by one-permutation MinHash.

Shingles of five words are hashed once.  The low bits of a hash choose one of
``BINS`` bins, the others are its value; a bin keeps its least value.  An
empty bin borrows from the first occupied bin of a random sequence of its own
(optimal densification), which ends in a permutation, so that it always finds
one.  The low ``KEPT_BITS`` bits of each bin are packed; the likeness of two
fingerprints is their share of equal bins, corrected for bins that are equal
by chance.

All of it is DataFrame functions over the words of a row: no shuffle but the
one that brings a document and its successor together.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SHINGLE, BIN_BITS, KEPT_BITS = 5, 8, 8
BINS = 1 << BIN_BITS
#: A bin's place in an ordered value, and the mark of an empty bin.
_SHIFT = 63 - BIN_BITS
_EMPTY = (1 << _SHIFT) - 1
#: Bins that an empty bin looks at before it ranks all occupied ones.
PROBES = 12
#: Rows of a range of ids, and the most ranges.
RANGE_ROWS, MAX_RANGES = 2000, 20_000


def probe_table() -> list[list[int]]:
    rng = random.Random(7)
    return [[rng.randrange(BINS) for _ in range(PROBES)] for _ in range(BINS)]


def fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the packed fingerprint of column ``text`` in hex digits.

    Words are parted by white space.  A text of fewer than five words is one
    shingle; one without words, or null, has the shingle of no words.
    """
    words, bins, filled, least = (f"__{x}" for x in ("words", "bins", "filled", "least"))
    df = df.withColumn(words, F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), ""))
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    value = lambda h: F.shiftleft(h.bitwiseAND(F.lit(BINS - 1).cast("long")), _SHIFT).bitwiseOR(F.shiftrightunsigned(h, BIN_BITS + 1))
    marks = F.lit([b << _SHIFT | _EMPTY for b in range(BINS)])
    # every bin has a mark behind its values, so the first of each is its least or the mark
    df = df.withColumn(bins, F.sort_array(F.concat(F.transform(hashes, value), marks)))
    df = df.withColumn(least, F.filter(bins, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(bins, i - 1), _SHIFT))))
    occupied = lambda x: x.bitwiseAND(F.lit(_EMPTY)) != _EMPTY
    df = df.withColumn(filled, F.filter(least, occupied))
    table = F.array(*(F.lit(row) for row in probe_table()))
    nearest = lambda b: F.get(F.filter(F.transform(F.get(table, b), lambda p: F.get(least, p)), occupied), F.lit(0))
    ranked = lambda b: F.array_min(F.transform(filled, lambda v: F.struct(F.xxhash64(b, F.shiftright(v, _SHIFT)).alias("rank"), v.alias("v"))))["v"]
    dense = F.transform(least, lambda x, b: F.when(occupied(x), x).otherwise(F.coalesce(nearest(b), ranked(b))))
    digits = F.transform(dense, lambda v: F.lpad(F.hex(v.bitwiseAND(F.lit((1 << KEPT_BITS) - 1).cast("long"))), KEPT_BITS // 4, "0"))
    return df.withColumn(out, F.lower(F.array_join(digits, ""))).drop(words, bins, filled, least)


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two fingerprints, 0 to 1."""
    width = KEPT_BITS // 4
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substr(a, i * width + 1, F.lit(width)) == F.substr(b, i * width + 1, F.lit(width)))) / BINS
    chance = 2.0**-KEPT_BITS
    return F.greatest((same - chance) / (1 - chance), F.lit(0.0))


def range_of(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most ``value``, found in two steps."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    group = F.size(F.filter(F.lit([g[0] for g in groups]), lambda b: b <= value))
    inner = F.get(F.array(*(F.lit(g) for g in groups)), F.greatest(group - 1, F.lit(0)))
    return F.when(group <= 0, F.lit(0)).otherwise((group - 1) * step + F.size(F.filter(inner, lambda b: b <= value)))


def with_next(docs: DataFrame) -> DataFrame:
    """(span, last, doc_id, digest, text) of each document, where the rows of
    a span are consecutive by id and each span also holds, marked ``last``,
    the document that follows it (after the last one, the first).

    Null ids come first; rows of equal id follow one another by a digest of
    their text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    spans = min(max(64, math.ceil(ids.count() / RANGE_ROWS)), MAX_RANGES)
    points = [i / spans for i in range(1, spans)]
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", points, max(10_000, 10 * spans))).first()[0] or []))
    rows = rows.select(range_of(F.col("doc_id"), bounds).alias("span"), F.lit(False).alias("last"), "doc_id", F.xxhash64("text").alias("digest"), "text")
    firsts = sorted(rows.groupBy("span").agg(F.min(F.struct("doc_id", "digest")).alias("f")).collect(), key=lambda r: r.span)  # at most MAX_RANGES rows
    followers = [(firsts[i - 1].span, r.f.doc_id, r.f.digest) for i, r in enumerate(firsts)]
    follows = docs.sparkSession.createDataFrame(followers, "to int, first long, of long")
    after = rows.join(F.broadcast(follows), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("of"))).dropDuplicates(["to"])
    return rows.union(after.select(F.col("to").alias("span"), F.lit(True).alias("last"), "doc_id", "digest", "text"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text.

    The edited text keeps the first half and goes on with as many characters
    of the next document.  Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.  A null text is
    empty; of a single document the next is itself; repeated rows stay; other
    columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    if docs.select("doc_id").isEmpty():
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    order = Window.partitionBy("span").orderBy("last", "doc_id", "digest")
    rows = with_next(docs).withColumn("next", F.lead("text").over(order)).withColumn("n_chars", F.char_length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars") - half), F.substr(F.coalesce("next", F.lit("")), F.lit(1), half))).drop("next")
    rows = fingerprinted(rows, "text", "fingerprint").drop("text")
    rows = fingerprinted(rows, "edited", "edited_fingerprint").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("not last")
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
