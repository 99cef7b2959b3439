"""Operator 11: mixing sources to target weights by hash-threshold histograms.

Each document has a key of hashes.  A source's documents whose key lies below a
threshold are taken, so a larger budget takes all that a smaller one does.  The
threshold comes from a histogram of words over the first bits of the key: the
bucket in which the running sum passes the budget is the only one that is
looked into by the next bits, until it holds a single document.  That document
is cut where the budget ends; nothing is sorted.

Budgets beyond a source's size take all of its documents as often as they fit,
and the rest by the threshold.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources, repeating; size of the mix and most of a source, as shares of the sizes.
WEIGHTS, SHARE, MOST = (3, 1, 2), Fraction(3, 2), 2
#: Bits of each part of a key, of which there are three, and of a histogram's buckets.
KEY_BITS, LEVEL_BITS, PARTS = 60, 12, 3
#: Sources that one task ranks.
RANKED = 1_000_000


def size_of(text: Column) -> Column:
    """Number of words, parted by ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key_of(doc_id: Column, text: Column) -> list[Column]:
    """The parts of a key: of the id, of the text, and of the place among equal rows."""
    return [
        F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("long"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS),
        F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - KEY_BITS),
    ]


def _sized(docs: DataFrame) -> DataFrame:
    keys = [k.alias(f"k{n}") for n, k in enumerate(key_of(F.col("doc_id"), F.col("text")))]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size"), *keys)


def ranked_sources(sized: DataFrame) -> DataFrame:
    """source, source_size, place (by code point, null last, from 0)."""
    sources = common.stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = [F.col("source").asc_nulls_last()]
    parts = 1 + sources.count() // RANKED
    dealt = common.stored(sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    before, starts = 0, []
    for row in dealt.groupBy("part").count().orderBy("part").collect():  # a row for each million of sources
        starts.append((row["part"], before))
        before += row["count"]
    offsets = sized.sparkSession.createDataFrame(starts, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("n", place).join(offsets, "part").select("source", "source_size", (F.col("n") + F.col("before")).alias("place"))


@dataclass
class Level:
    """What a weight gets: ``remaining / weights`` a unit; sources above ``most`` times their size aside."""

    remaining: int
    weights: int
    scale: int

    def above(self, cap: Column, weight: Column) -> Column:
        exact = lambda c: c.cast("decimal(20,0)")
        return exact(cap) * F.lit(Decimal(self.weights * self.scale)) < exact(weight) * F.lit(Decimal(self.remaining))

    def target(self, weight: int) -> float:
        return weight * self.remaining / (self.weights * self.scale) if self.weights else 0.0

    def budget(self, weight: int) -> int:
        unit = 2 * self.weights * self.scale
        return (2 * weight * self.remaining + unit // 2) // unit if unit else 0


def level_of(sources: DataFrame, share: Fraction) -> Level:
    """Reshare by weight what sources leave that reach their cap, until none is above.

    ``sources`` has source_size, cap and weight.  Each round is a sum over the
    sources; it is Newton's method on a concave sum, so rounds are few.
    """
    first = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    whole = share.numerator * (first[0] or 0)
    level, fixed = Level(whole, first[1] or 0, share.denominator), -1
    while True:
        above = level.above(F.col("cap"), F.col("weight"))
        row = sources.agg(F.sum(F.when(above, F.col("cap")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.count_if(above)).first()
        if (row[2] or 0) == fixed or not row[1]:
            return level
        fixed = row[2]
        level = Level(whole - share.denominator * (row[0] or 0), row[1], share.denominator)


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target, copies (times that all of it is taken) and rest (words beyond)."""
    weight = F.element_at(F.lit(list(weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    sources = common.stored(ranked_sources(sized).select("source", "source_size", (most * F.col("source_size")).alias("cap"), weight.alias("weight")), "weighted")
    level = level_of(sources, share)
    by_weight = lambda f: F.element_at(F.create_map(*[F.lit(x) for w in sorted(set(weights)) for x in (w, f(w))]), F.col("weight").cast("int"))
    capped = level.above(F.col("cap"), F.col("weight")) | F.lit(share >= most)
    target = F.when(capped, F.col("cap").cast("double")).otherwise(by_weight(level.target))
    budget = F.when(capped, F.col("cap")).otherwise(F.least(F.col("cap"), by_weight(level.budget)))
    found = sources.select("source", "source_size", target.alias("target"), budget.alias("budget"))
    copies = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long"))
    return found.withColumn("copies", copies).select("source", "source_size", "target", "copies", (F.col("budget") - F.col("copies") * F.col("source_size")).alias("rest"))


def _prefix(level: int) -> list[Column]:
    """The first ``level`` digits of a key, part by part."""
    bits = [min(KEY_BITS, level * LEVEL_BITS - n * KEY_BITS) for n in range(PARTS)]
    return [F.shiftright(f"k{n}", KEY_BITS - b) for n, b in enumerate(bits) if b > 0]


def _here(prefix: list[Column]) -> tuple[Column, Column]:
    """Whether a key's prefix lies below the threshold, and on it."""
    own, bound = F.struct(*prefix), F.struct(*(F.col(f"t{n}") for n in range(len(prefix))))
    return own < bound, own == bound


def thresholds(sized: DataFrame, budgets: DataFrame) -> tuple[DataFrame, int]:
    """For sources with a rest: of (source, t0 ..., within, words), the bucket
    in which the rest ends, how many words of it are taken and how many it has;
    and the number of digits in these buckets."""
    frontier = budgets.where("rest > 0").select(F.col("source").alias("of"), F.col("rest").alias("within"))
    for level in range(KEY_BITS // LEVEL_BITS * PARTS):
        same = sized["source"].eqNullSafe(frontier["of"])
        if level:
            same = same & _here(_prefix(level))[1]
        digit = [c.alias(f"d{n}") for n, c in enumerate(_prefix(level + 1))]
        histogram = sized.join(frontier, same).groupBy("of", "within", *digit).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        names = [f"d{n}" for n in range(len(digit))]
        before = F.sum("words").over(Window.partitionBy("of").orderBy(*names)) - F.col("words")  # 4,096 buckets at most
        boundary = histogram.withColumn("before", before).where("before <= within and within < before + words")
        frontier = common.stored(boundary.select("of", *(F.col(c).alias(f"t{n}") for n, c in enumerate(names)), (F.col("within") - F.col("before")).alias("within"), "words", "n"), "frontier")
        if (frontier.agg(F.max(F.when(F.col("within") > 0, F.col("n")))).first()[0] or 1) == 1:
            break
    return frontier.drop("n"), level + 1


def _with_taken(rows: DataFrame, budgets: DataFrame, frontier: DataFrame, digits: int) -> DataFrame:
    """``rows`` with source_size, target, copies and part: the words taken beyond whole copies."""
    below, on = _here(_prefix(digits))
    cut = F.floor(F.col("size").cast("decimal(20,0)") * F.col("within").cast("decimal(18,0)") / F.col("words").cast("decimal(18,0)")).cast("long")
    part = F.when(below, F.col("size")).when(on, F.when(F.col("size") == F.col("words"), F.col("within")).otherwise(cut)).otherwise(F.lit(0).cast("long"))
    found = budgets.withColumnRenamed("source", "of_all").join(frontier, F.col("of_all").eqNullSafe(F.col("of")) & (F.col("rest") > 0), "left").drop("of", "rest")
    return rows.join(found, F.col("source").eqNullSafe(F.col("of_all"))).withColumn("part", part)


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document.

    A source's words come within one of its target.  Null texts have size 0;
    null sources are one source, the last, apart from the empty string; a mix
    of no words takes none.  Rows of one id are told apart by their text, and
    equal rows by their place, which of them is taken changes no result; null
    ids are ids of their own kind.  A ``share`` of ``most`` or more takes
    everything ``most`` times.  Other columns are not read.
    """
    sized = common.stored(_sized(docs), "sized")
    budgets = common.stored(targets(sized, weights, share, most), "budgets")
    rows = _with_taken(sized, budgets, *thresholds(sized, budgets))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, counts: pa.Array) -> pa.Array:
        out = []
        for text, n in zip(texts.to_pylist(), counts.to_pylist(), strict=True):
            end = 0
            for count, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text or ""), 1):
                if count > n:
                    break
                end = m.end()
            out.append((text or "")[:end])
        return pa.array(out, pa.string())

    return cut(text, n)


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time that a
    document is taken, the text of one that a budget ends in cut there.
    Documents of no words aren't in it."""
    common.small_batches(docs.sparkSession)
    sized = common.stored(_sized(docs), "sized")
    budgets = common.stored(targets(sized, weights, share, most), "budgets")
    keys = [k.alias(f"k{n}") for n, k in enumerate(key_of(F.col("doc_id"), F.col("text")))]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "source", size_of(F.col("text")).alias("size"), *keys)
    rows = _with_taken(rows, budgets, *thresholds(sized, budgets)).where("size > 0")
    whole = rows.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0).cast("long")))).where("time > 0 and time <= copies + least(part, 1)")
    is_cut = (F.col("time") > F.col("copies")) & (F.col("part") < F.col("size"))
    kept = whole.where(~is_cut).select("row.*")
    cut = whole.where(is_cut).withColumn("row", F.col("row").withField("text", first_words(F.col("row.text"), F.col("part")))).select("row.*")
    return kept.unionByName(cut)


#: The same in DuckDB, where a running sum over each source's keys stands for the histograms.
ORACLE_SQL = """
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size, ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as k from documents),
sources as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place from sized group by source),
weighted as (select *, 2 * source_size as cap, case place % 3 when 0 then 3 when 1 then 1 else 2 end as weight from sources),
ordered as (select *, sum(cap) over w as caps, sum(weight) over w as weights, cap::double / weight as ratio, sum(source_size) over () as words, sum(weight) over () as all_weights from weighted window w as (order by cap::double / weight, place rows between unbounded preceding and 1 preceding)),
levels as (select (3 * words - 2 * coalesce(caps, 0))::double as remaining, (2 * (all_weights - coalesce(weights, 0)))::double as units, ratio, place from ordered),
level as (select remaining, units from levels where ratio >= remaining / units order by ratio, place limit 1),
budgets as (select source, source_size, case when cap < weight * remaining / units then cap::double else weight * remaining / units end as target from weighted, level),
taken as (select doc_id, size, source_size, target, floor(target + 0.5)::bigint as budget, (sum(size) over (partition by s.source order by k) - size)::bigint as before from sized s join budgets b on s.source is not distinct from b.source)
select doc_id, size, source_size, target, (case when source_size = 0 then 0 else (budget // source_size) * size + least(size, greatest(0, budget - (budget // source_size) * source_size - before)) end)::bigint as taken from taken
"""
