"""Operator 13: how filters interact, by the Hart-Mas-Colell potential.

A document's failures are a mask of five bits, so a part of the table is a
histogram of 32 masks.  v(S), what the filters of coalition S remove together,
comes from it for all 32 coalitions.  The potential of the removal game is
P(S) = (v(S) + sum of P(S without i)) / |S|, and a filter's Shapley value is
P(all) - P(all without it): over all orders its mean removal.  What a step of
an order removes, keeps or loses is a difference of two coalitions.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
#: Failure conditions: fewer words; fewer distinct words in 100; more capitals in 100 code points.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS, CAPITALS = b"#$%&*|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MASKS = 1 << len(FILTERS)
#: All filters but the last, which needs the other texts, look at one text.
COPY = 1 << FILTERS.index("E")


def failures(raw: bytes) -> int:
    """The mask of filters A to D that a UTF-8 text fails, A lowest."""
    words = raw.split()
    code_points = len(raw) if raw.isascii() else len(raw.decode())
    failed = len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    failed += 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MOST_CAPITALS * code_points, len(raw.translate(None, SYMBOLS)) < len(raw)
    return sum(1 << n for n, bad in enumerate(failed) if bad)


def looked_at(text: Column) -> Column:
    """Struct of the mask and the SHA-256 digest of a text; null is empty."""

    @F.arrow_udf("struct<mask: int, digest: binary>")
    def look(texts: pa.Array) -> pa.Array:
        masks, digests = [], []
        for raw in common.text_bytes(texts):
            masks.append(failures(raw))
            digests.append(hashlib.sha256(raw).digest())
        return pa.StructArray.from_arrays([pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["mask", "digest"])

    return look(text)


def failed_documents(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part and mask of every document, copies of a smaller id included.

    The smallest id of a text is worked out only for texts that have several
    ids; the rows of one text are never brought together.
    """
    common.small_batches(docs.sparkSession)
    looked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), looked_at(F.col("text")).alias("of"))
    rows = common.stored(looked.select("doc_id", "part", "of.mask", "of.digest"), "failures")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    copy = F.when(F.col("doc_id") > F.col("first"), COPY).otherwise(0)
    return rows.join(firsts, "digest", "left").select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def histograms(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, and arrays of 32 counts: of all documents, good and toxic ones."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"))
    marks = marks.where("doc_id is not null and good + bad > 0")
    counted = failed.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    of_part = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "bad").alias("c")))).alias("by_mask"))  # 32 entries at most
    array = lambda name: F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.coalesce(F.col("by_mask")[m][name], F.lit(0).cast("long")))
    return of_part.select("part", array("n").alias("n"), array("good").alias("good"), array("bad").alias("bad"))


def removed_by(counts: np.ndarray) -> np.ndarray:
    """v of all coalitions: documents whose mask meets the coalition."""
    masks = np.arange(len(counts))
    return (masks[:, None] & masks > 0) @ counts


def potentials(v: np.ndarray) -> np.ndarray:
    """Potentials of all coalitions times n!, which are whole numbers."""
    scale = int(np.prod(np.arange(1, len(v).bit_length())))
    out = [0] * len(v)
    for coalition in range(1, len(v)):
        members = [1 << i for i in range(coalition.bit_length()) if coalition >> i & 1]
        out[coalition] = (scale * int(v[coalition]) + sum(out[coalition ^ i] for i in members)) // len(members)
    return np.array(out, object)


def steps_of(counts: np.ndarray, good: np.ndarray, bad: np.ndarray) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    v, of_good, of_bad = map(removed_by, (counts, good, bad))
    potential, everything = potentials(v), len(v) - 1
    shapley = [int(potential[everything] - potential[everything ^ 1 << i]) for i in range(len(FILTERS))]
    for order in itertools.permutations(range(len(FILTERS))):
        before, name = 0, "".join(FILTERS[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = int(v[after] - v[before])
            yield name, step, int(counts.sum() - v[after]), removed, int(v[1 << i]) - removed, int(counts[1 << i]), int(of_good[after] - of_good[before]), int(of_bad[after] - of_bad[before]), shapley[i]
            before = after


COLUMNS = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """For each part, each of the 120 orders and each step: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, and shapley, which is the
    filter's removals summed over all orders.

    Null texts are empty, and copies of each other; null parts are the empty
    string.  A null id is no smaller than any id and larger than none, so its
    document is no copy and makes none; rows of one id don't make each other
    copies.  Any label row of an id counts; null and unknown labels don't.  An
    empty table has no parts.  Other columns are not read.
    """

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(row.part, *found) for row in batch.itertuples() for found in steps_of(*(np.asarray(x, np.int64) for x in (row.n, row.good, row.bad)))]
            yield pd.DataFrame(rows, columns=["part", *COLUMNS])

    counted = histograms(failed_documents(docs, part), labels)
    return counted.mapInPandas(steps, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def without_failures(docs: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The documents that pass the named filters, with all their columns."""
    common.small_batches(docs.sparkSession)
    wanted = sum(1 << FILTERS.index(f) for f in filters)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), looked_at(F.col("text")).alias("of")).select("row", "id", "of.mask", "of.digest")
    if wanted & COPY:
        firsts = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
        rows = rows.join(firsts, "digest", "left").where("first is null or id is null or id <= first")
    return rows.where(F.col("mask").bitwiseAND(wanted) == 0).select("row.*")


#: The same in DuckDB: each order's documents one by one, and sums over the orders.
ORACLE_SQL = """
with words as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
failed as (select doc_id, part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by text), false)] as fails from words),
marked as (select f.*, exists (select 1 from labels l where l.doc_id = f.doc_id and quality = 1) as good, exists (select 1 from labels l where l.doc_id = f.doc_id and toxic = 1) as bad from failed f),
kinds as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (bad) as bad from marked group by all),
places as (select unnest([1, 2, 3, 4, 5]) as p),
orders as (select [a.p, b.p, c.p, d.p, e.p] as o from places a, places b, places c, places d, places e where len(list_distinct([a.p, b.p, c.p, d.p, e.p])) = 5),
steps as (select o, array_to_string(list_transform(o, lambda x: substr('ABCDE', x::int, 1)), '') as filter_order, p as step, o[p] as f, o[1:p - 1] as before from orders, places),
counted as (
  select part, filter_order, step, f,
    sum(n) filter (not fails[f] and not list_bool_or(list_transform(before, lambda x: fails[x])) is true) as kept,
    sum(n) filter (fails[f] and not list_bool_or(list_transform(before, lambda x: fails[x])) is true) as removed,
    sum(n) filter (fails[f] and list_bool_or(list_transform(before, lambda x: fails[x])) is true) as redundant,
    sum(n) filter (fails[f] and len(list_filter(fails, lambda x: x)) = 1) as unique_fails,
    sum(good) filter (fails[f] and not list_bool_or(list_transform(before, lambda x: fails[x])) is true) as good_lost,
    sum(bad) filter (fails[f] and not list_bool_or(list_transform(before, lambda x: fails[x])) is true) as toxic_lost
  from kinds, steps group by part, filter_order, step, f)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  (sum(coalesce(removed, 0)) over (partition by part, f))::bigint as shapley from counted
"""
