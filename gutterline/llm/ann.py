"""Operator 9: approximate nearest neighbours, inverted file with product
quantisation.

Vectors are dealt to lists of coarse centroids; a list keeps the residual of
each vector as one byte a subspace.  A query visits the lists of best
centroids, adds its distance table over the bytes of each vector there, and
measures the best of each block exactly on the original vectors.

The quantisers are fitted on a sample, which also chooses how many lists are
visited: the fewest that find ``TARGET_RECALL`` of the sample's own true
neighbours, and more where these hold few vectors.  Lists grow with the square
root of the table and are dealt on to blocks of about ``BLOCK`` vectors, so a
list that holds a third of all vectors is many rows, and a short one is a
single block.

Vectors have neighbours among those of their own length.  Lengths that a
sixteenth of the rows have get quantisers of their own; any other length is
one list, which is measured exactly.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fit on so many vectors at least, and ``PER_LIST`` for each list; the least
#: lists, and how many more there are, as a share of the root of the rows.
SAMPLE, PER_LIST, LEAST_LISTS, OF_ROOT = 8192, 16, 64, 0.5
#: A length of vectors that this share of the rows has is quantised.
COMMON_LENGTH = 1 / 16
#: A query visits lists until they hold so many vectors for each neighbour.
LEAST_SEEN = 64
#: Bytes a vector, codes a byte, rounds of k-means.
SUBSPACES, CODES, ROUNDS = 16, 64, 8
TARGET_RECALL = 0.97
#: Vectors of a block, and how many of a block are measured exactly for k neighbours.
BLOCK, RERANK = 2048, 6


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's algorithm; fewer centroids if there are fewer distinct rows."""
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].astype(np.float32)
    for _ in range(rounds):
        near = nearest(x, centres)
        sums, n = np.zeros(centres.shape, np.float64), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


def two_level(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """About ``k`` centroids: those of the parts of a coarser clustering, in
    proportion to their rows, so that the work grows with k ** 1.5 alone."""
    if k <= 256:
        return k_means(x, k, rng)
    near = nearest(x, k_means(x, math.isqrt(k), rng))
    return np.concatenate([k_means(x[near == part], max(1, round(k * (near == part).mean())), rng) for part in np.unique(near)])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centroid (Euclidean) of each row."""
    out = np.empty(len(x), np.int64)
    norms = (centres.astype(np.float64) ** 2).sum(1) / 2
    for a in range(0, len(x), 8192):
        out[a : a + 8192] = (x[a : a + 8192] @ centres.T - norms).argmax(1)
    return out


@dataclass
class Quantiser:
    """Coarse centroids, codebooks (subspace, code, dimension), and how many
    lists a query visits, all for vectors over two to the ``exponent``."""

    coarse: np.ndarray
    books: np.ndarray
    probes: int
    exponent: int = 0

    @classmethod
    def fit(cls, sample: np.ndarray, k: int, lists: int = LEAST_LISTS) -> Quantiser:
        rng = np.random.default_rng(0)
        width = -(-sample.shape[1] // SUBSPACES)
        coarse = two_level(sample, max(1, min(lists, len(sample) // PER_LIST)), rng)
        near = nearest(sample, coarse)
        residual = padded(sample - coarse[near], width)
        books = [k_means(residual[:, s * width : (s + 1) * width], CODES, rng) for s in range(SUBSPACES)]
        most = max(map(len, books))
        books = np.stack([np.concatenate([b, np.repeat(b[:1], most - len(b), axis=0)]) for b in books])
        found = cls(coarse, books, len(coarse))
        queries = rng.permutation(len(sample))[:256]
        scores = sample[queries] @ sample.T
        scores[np.arange(len(queries)), queries] = -np.inf
        best = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
        place = np.argsort(np.argsort(-(sample[queries] @ coarse.T), axis=1), axis=1)
        visited = np.take_along_axis(place, near[best], axis=1)
        while found.probes > 1 and best.size and (visited < found.probes - 1).mean() >= TARGET_RECALL:
            found.probes -= 1
        return found

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        width = self.books.shape[2]
        residual = padded(x - self.coarse[lists], width)
        return np.stack([nearest(residual[:, s * width : (s + 1) * width], self.books[s]) for s in range(SUBSPACES)], axis=1).astype(np.uint8)

    def visited(self, queries: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The lists in the order in which each query visits them, and how
        many it visits: ``probes``, and until they hold ``least`` vectors."""
        order = np.argsort(-(queries @ self.coarse.T), axis=1, kind="stable")
        enough = (np.cumsum(sizes[order], axis=1) < least).sum(1) + 1
        return order, np.minimum(np.maximum(enough, self.probes), len(self.coarse))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with each code: (query, subspace, code)."""
        width = self.books.shape[2]
        parts = padded(queries, width).reshape(len(queries), SUBSPACES, width)
        return np.einsum("qsw,scw->qsc", parts, self.books)


def over(x: np.ndarray, exponent: np.ndarray | int) -> np.ndarray:
    """Vectors over powers of two, as floats: any doubles have a place there."""
    return np.ldexp(x.astype(np.float64), -np.asarray(exponent)).astype(np.float32)


def as_query(x: np.ndarray) -> np.ndarray:
    """Each query over a power of two of its own, which changes no order of scores."""
    return over(x, np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width * SUBSPACES - x.shape[1])))


def best_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """The k best places of a row of scores, and all that equal the last of
    them: vectors that share all codes are told apart by exact measures only."""
    if len(scores) <= k:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= np.partition(scores, -k)[-k])


def search_block(quantiser: Quantiser | None, list_id: int, keys: np.ndarray, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray, asking: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """Each query's k best of a block (by ascending id): ranked by table, then
    measured in double precision; without a quantiser all are measured."""
    out = []
    exact, queries = vectors.astype(np.float64), queries.astype(np.float64)
    for a in range(0, len(queries), 256):
        some, names = queries[a : a + 256], asking[a : a + 256]
        if quantiser:
            near = as_query(some)
            tables = quantiser.tables(near)
            rough = np.repeat((near.astype(np.float64) @ quantiser.coarse[list_id])[:, None], len(keys), axis=1)
            for s in range(SUBSPACES):
                rough += tables[:, s, codes[:, s]]
        else:
            rough = np.stack([(exact * q).sum(1) for q in some])
        rough[names[:, None] == keys] = -np.inf
        for q, scores in enumerate(rough):
            rows = best_rows(scores, (RERANK if quantiser else 1) * k)
            rows = rows[scores[rows] > -np.inf]
            measured = (exact[rows] * some[q]).sum(1)
            order = np.lexsort((ids[rows], -measured))[:k]
            out += zip([int(names[q])] * len(order), ids[rows[order]].tolist(), measured[order].tolist(), strict=True)
    return out


_LOADED: dict[str, dict[int, Quantiser]] = {}


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite, non-null components, not all
    zero, each under a key of its own; components are doubles unless they are
    floats already."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    rows = vectors.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    rows = rows.where("vec_id is not null and v is not null and size(v) > 0").where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    return rows.withColumn("width", F.size("v"))


def fitted(rows: DataFrame, k: int, common_widths: list[int], counts: dict[int, int], largest: dict[int, float]) -> dict[int, Quantiser]:
    """A quantiser for each common length, over the power of two that holds
    its ``largest`` component; the sample grows with the square root of the
    rows."""
    out = {}
    for width in common_widths:
        own, total = rows.where(F.col("width") == width), counts[width]
        lists = max(LEAST_LISTS, int(OF_ROOT * math.isqrt(total)))
        most = max(SAMPLE, PER_LIST * lists)
        # a little more than is wanted, so that the smallest hashes of the rows are surely among these
        share = min(1.0, 2 * most / total)
        picked = own.select("v", F.xxhash64("key").alias("h")).where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy("h").limit(most)
        exponent = math.frexp(largest[width])[1]
        out[width] = Quantiser.fit(over(np.array([r.v for r in picked.collect()], np.float64), exponent), k, lists)
        out[width].exponent = exponent
    return out


def neighbours(vectors: DataFrame, k: int = 20, query_every: int = 20) -> DataFrame:
    """Each query's k nearest by inner product: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``query_every``; candidates
    are all other rows with a vector of the same length, also those that share
    the query's id.  Rows with the same id are rows of their own, as queries
    too (their ranks start from 1 each).  Null, zero or non-finite vectors
    take no part; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    rows = common.stored(usable(vectors), "vectors")
    sized = rows.groupBy("width").agg(F.count("*").alias("count"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("largest"))
    found = sorted(sized.orderBy(F.desc("count"), "width").limit(int(1 / COMMON_LENGTH)).collect())
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total, counts = rows.count(), {r.width: r["count"] for r in found}
    kind = "<f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    quantisers = fitted(rows, k, [w for w, n in counts.items() if n >= COMMON_LENGTH * total], counts, {r.width: r.largest for r in found})
    shared, mark = spark.sparkContext.broadcast(quantisers), uuid.uuid4().hex

    def loaded() -> dict[int, Quantiser]:
        if mark not in _LOADED:
            _LOADED.clear()
            _LOADED[mark] = shared.value
        return _LOADED[mark]

    def matrix(column: pa.Array, width: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)

    def by_width(widths: pa.Array):
        """Rows of a batch for each length."""
        sizes = widths.to_numpy()
        return [(int(w), np.flatnonzero(sizes == w)) for w in np.unique(sizes)]

    @F.arrow_udf("int")
    def list_of(vectors: pa.Array, widths: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors), np.int32)
        for width, rows in by_width(widths):
            if quantiser := loaded().get(width):
                out[rows] = nearest(over(matrix(vectors.take(pa.array(rows)), width), quantiser.exponent), quantiser.coarse)
        return pa.array(out)

    def encode(members: pa.Table) -> pa.Table:
        """A block: its vectors by ascending id, their codes and themselves."""
        members = members.combine_chunks().sort_by([("vec_id", "ascending"), ("key", "ascending")])
        width, list_id = members.column("width")[0].as_py(), members.column("list")[0].as_py()
        vectors = matrix(members.column("v").chunk(0), width)
        quantiser = loaded().get(width)
        codes = quantiser.encode(over(vectors, quantiser.exponent), np.full(len(vectors), list_id)) if quantiser else np.zeros(0, np.uint8)
        columns = {n: pa.array([members.column(n)[0].as_py()], pa.int32()) for n in ("width", "list", "block")}
        blobs = {"keys": members.column("key").to_numpy().astype("<i8"), "ids": members.column("vec_id").to_numpy().astype("<i8"), "codes": codes, "vectors": vectors}
        return pa.table(columns | {n: pa.array([b.tobytes()], pa.binary()) for n, b in blobs.items()})

    listed = common.stored(rows.withColumn("list", list_of("v", "width")), "lists")
    counted = listed.groupBy("width", "list").agg(F.count("*").alias("n"))
    blocks = counted.select("width", "list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    sizes = {w: np.zeros(len(q.coarse), np.int64) for w, q in quantisers.items()}
    for r in counted.where(F.col("width").isin(list(sizes))).collect():  # a row a list: they grow with the root of the rows
        sizes[r.width][r.list] = r.n

    def ask(batches):
        for batch in batches:
            keys, out = batch.column(0).to_numpy(), []
            for width, rows in by_width(batch.column(2)):
                x = matrix(batch.column(1).take(pa.array(rows)), width)
                if quantiser := loaded().get(width):
                    order, enough = quantiser.visited(as_query(x), sizes[width], LEAST_SEEN * k)
                    query, lists = np.repeat(np.arange(len(rows)), enough), np.concatenate([o[:n] for o, n in zip(order, enough.tolist(), strict=True)])
                else:
                    query, lists = np.arange(len(rows)), np.zeros(len(rows), np.int64)
                for list_id in np.unique(lists):
                    members = query[lists == list_id]
                    out.append((width, int(list_id), keys[rows[members]].astype("<i8").tobytes(), x[members].tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["width", "list", "asking", "queries"])

    def search(batches):
        for batch in batches:
            best = []
            for width, list_id, keys, ids, codes, stored, asking, queries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                of = lambda raw: np.frombuffer(raw, kind).reshape(-1, width)  # noqa: E731,B023
                coded = np.frombuffer(codes, np.uint8).reshape(-1, SUBSPACES)
                best += search_block(loaded().get(width), list_id, np.frombuffer(keys, "<i8"), np.frombuffer(ids, "<i8"), coded, of(stored), np.frombuffer(asking, "<i8"), of(queries), k)
            columns = list(zip(*best, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["asking", "vec_id", "score"])

    place = ["width", "list"]
    dealt = listed.join(blocks, place).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    index = common.stored(dealt.select(*place, "block", "key", "vec_id", "v").groupBy(*place, "block").applyInArrow(encode, "width int, list int, block int, keys binary, ids binary, codes binary, vectors binary"), "index")
    queries = rows.where(F.col("vec_id") % query_every == 0)
    asked = queries.select("key", "v", "width").mapInArrow(ask, "width int, list int, asking binary, queries binary")
    sent = asked.join(blocks, place).select(*place, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "asking", "queries")
    pairs = index.join(sent, [*place, "block"]).select(*place, "keys", "ids", "codes", "vectors", "asking", "queries")
    answers = pairs.mapInArrow(search, "asking long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("score"), "vec_id"))
    best = answers.withColumn("rank", rank).where(F.col("rank") <= k)
    names = queries.select(F.col("key").alias("asking"), F.col("vec_id").alias("query_id"))
    return best.join(names, "asking").select("query_id", "rank", "vec_id", "score")
