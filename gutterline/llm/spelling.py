"""Operator 12: spelling variants by search schemes over FM-indexes of the vocabulary.

Two words at one edit agree before the edit and behind it, so they agree in a
whole half.  A search matches that half exactly from the delimiter on, goes on
over the other half, allows one error there, and ends at the next delimiter.
Intervals of suffix ranks are narrowed character by character, for many
searches at once: left halves in the index that is read forwards, right halves
in the one read backwards.

The vocabulary is dealt into shards by the halves that searches hold fixed:
words that share one meet in a shard, which has both indexes of its words.
Halves that many words share are cut again, and the words are dealt by what
lies outside the piece that may hold the error; pieces of one character end
that, as few words differ in one character only.  A pair is reported by the
search whose piece holds the first place in which its words differ, once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Of the words that count: code points and occurrences; how much commoner a form is.
LEAST_LENGTH, LEAST_COUNT, COMMONER = 6, 5, 5
#: One word in so many of a document loses a code point.
DAMAGED = 199
#: Code points of a shard's searches; words that share a half before it is cut again.
SHARD, CROWDED = 1 << 19, 1 << 12
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000

#: Latin-1: what stands in words, capitals A-Z lowered, and spaces for all else.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def words_of(doc_id: int | None, text: str | None) -> Counter[str]:
    """The words of a text and how often it has them, some damaged by a rule on id and word."""
    runs = Counter((text or "").encode("latin-1", "replace").translate(_LETTERS).split())
    seed, out = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id), Counter()
    seed = zlib.crc32(b":", seed)
    for run, n in runs.items():
        word = run.decode("latin-1")
        h = zlib.crc32(run if run.isascii() else word.encode(), seed)
        if h % DAMAGED == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n of the words that are long and frequent enough."""
    common.small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        seen: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen.update({w: n for w, n in words_of(doc_id, text.as_py()).items() if len(w) >= LEAST_LENGTH})
                if len(seen) > COUNTED:
                    yield written()
                    seen.clear()
        yield written()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keyed(rows: DataFrame, pieces: int) -> DataFrame:
    """``rows`` of word, n, short (code points of the shorter word of the pairs
    sought) and piece, with the piece's bounds in the shorter word and a key of
    what lies outside it, counted from both ends."""
    low, high = (F.floor(F.col("short") * (F.col("piece") + k) / pieces).cast("int") for k in (0, 1))
    bounded = rows.withColumns({"low": low, "high": high})
    return bounded.withColumn("key", F.xxhash64("short", "low", "high", F.expr("left(word, low)"), F.expr("right(word, short - high)")))


def searches(words: DataFrame) -> DataFrame:
    """word, n, short, low, high, key: the searches of each word.  The error
    lies in [low, high) of the shorter word; rows of a key share the rest."""
    length = F.char_length("word")
    short = F.array_compact(F.array(length, F.when(length > LEAST_LENGTH, length - 1)))
    halves = words.select("word", "n", F.explode(short).alias("short")).withColumn("piece", F.explode(F.array(F.lit(0), F.lit(1))))
    rows, pieces, done = common.stored(_keyed(halves, 2), "searches"), 2, []
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("high") - F.col("low")).alias("width"))
        crowded = common.stored(sizes.where((F.col("size") > CROWDED) & (F.col("width") > 1)).select("key"), "crowded")
        if crowded.isEmpty():
            break
        done.append(rows.join(crowded, "key", "left_anti"))
        pieces *= 2
        again = rows.join(crowded, "key", "left_semi").select("word", "n", "short", F.explode(F.array(F.col("piece") * 2, F.col("piece") * 2 + 1)).alias("piece"))
        rows = common.stored(_keyed(again, pieces), "searches")
    for part in done:
        rows = rows.unionByName(part)
    return rows.drop("piece")


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a text that goes round, in order, by doubling."""
    order = np.argsort(text, kind="stable")
    keys, rank, span = text[order], np.zeros(len(text), np.int64), 1
    while True:
        rank[order] = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
        if rank[order[-1]] == len(text) - 1 or span >= len(text):
            return order
        both = rank * len(text) + np.roll(rank, -span)
        order = np.argsort(both, kind="stable")
        keys, span = both[order], span * 2


class Index:
    """An FM-index of delimited words; code 0 is the delimiter, in front of each word and behind the last."""

    def __init__(self, words: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        text, letters = np.zeros(self.starts[-1] + 1, np.int64), np.ones(self.starts[-1] + 1, bool)
        letters[self.starts] = False
        text[letters] = np.concatenate(words)
        self.ranks, self.size = suffix_ranks(text), len(text)
        # the character before each suffix, then its rank: the place in here is where the longer suffix ranks
        self.before = np.sort(text[self.ranks - 1] * (self.size + 1) + np.arange(self.size))

    def step(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffix ranks of what was matched with ``code`` in front of it."""
        base = code * (self.size + 1)
        return np.searchsorted(self.before, base + low), np.searchsorted(self.before, base + high)

    def word_at(self, rank: np.ndarray) -> np.ndarray:
        """The word that the delimiter at these suffix ranks stands in front of."""
        return np.searchsorted(self.starts, self.ranks[rank], "right") - 1


class Queries:
    """Words to search, read from the delimiter of the exact half on.

    ``lengths`` and ``short`` (code points of the shorter word of a pair) say
    whether a character of the query is left out or one is put in or replaced;
    the error is the first difference, at a place from ``first`` to ``last``.
    """

    def __init__(self, words: list[np.ndarray], short: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.concatenate(words)
        self.longer, self.first, self.last = self.lengths > short, first, last

    def at(self, query: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        """The code at a place; behind the query stands the delimiter."""
        return np.where(place < self.lengths[query], self.flat[np.minimum(self.starts[query] + place, len(self.flat) - 1)], 0)


def _errors(index: Index, queries: Queries, codes: int, place: int, states: tuple) -> Iterator[tuple]:
    """States (query, next place, interval) after an error at ``place``."""
    query, low, high = states
    left_out = queries.longer[query] & (queries.at(query, place) != queries.at(query, place + 1))
    yield query[left_out], np.full(left_out.sum(), place + 1), low[left_out], high[left_out]
    query, low, high = (x[~queries.longer[query]] for x in states)
    wanted, inside = queries.at(query, place), place < queries.lengths[query]
    for code in range(1, codes):
        to_low, to_high = index.step(np.full(len(query), code), low, high)
        other = (to_low < to_high) & (code != wanted)
        yield query[other], np.full(other.sum(), place), to_low[other], to_high[other]
        other &= inside
        yield query[other], np.full(other.sum(), place + 1), to_low[other], to_high[other]


def matches(index: Index, queries: Queries, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) of all words at exactly one error from a query.

    All queries go on together: states without an error by their next
    character, and into every error that the interval allows; states with one
    by their next character, until the delimiter.
    """
    none = np.zeros(0, np.int64)
    everything = np.arange(len(queries.lengths))
    zero = np.zeros(len(everything), np.int64)
    exact = (everything, *index.step(zero, zero, zero + index.size))
    erring, found, place = (none, none, none, none), [(none, none)], 0
    while len(exact[0]) or len(erring[0]):
        may = (queries.first[exact[0]] <= place) & (place <= queries.last[exact[0]])
        erring = tuple(map(np.concatenate, zip(erring, *_errors(index, queries, codes, place, tuple(x[may] for x in exact)), strict=True)))
        query, at, low, high = erring
        low, high = index.step(queries.at(query, at), low, high)
        ended, on = (at == queries.lengths[query]) & (low < high), (at < queries.lengths[query]) & (low < high)
        found.append((query[ended], low[ended]))  # one suffix, since words are distinct
        erring = query[on], at[on] + 1, low[on], high[on]
        query, low, high = exact
        low, high = index.step(queries.at(query, place), low, high)
        on = (place < queries.lengths[query]) & (place < queries.last[query]) & (low < high)
        exact = query[on], low[on], high[on]
        place += 1
    query, rank = map(np.concatenate, zip(*found, strict=True))
    return query, index.word_at(rank)


def first_difference(a: str, b: str) -> int:
    return next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def shard_pairs(words: list[str], which: np.ndarray, short: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, near word) that the searches of a shard report.

    ``words`` are distinct; search k is of ``words[which[k]]``.  A piece in the
    left half is read from the right end on, others from the left end on.
    """
    joined = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    letters, codes = np.unique(joined, return_inverse=True)
    forwards = np.split(codes + 1, np.cumsum([len(w) for w in words])[:-1])
    backwards = [w[::-1] for w in forwards]
    pairs = []
    for mirrored, read, kept in ((False, forwards, backwards), (True, backwards, forwards)):
        own = np.flatnonzero((low + high <= short) == mirrored)
        if not len(own):
            continue
        # the index is of the words as they are read against the reading
        first, last = (short - high, short) if mirrored else (low, np.where(high == short, short, high - 1))
        queries = Queries([read[k] for k in which[own].tolist()], short[own], first[own], last[own])
        query, word = matches(Index(kept), queries, len(letters) + 1)
        search = own[query]
        if mirrored:
            place = np.fromiter((first_difference(words[a], words[b]) for a, b in zip(which[search].tolist(), word.tolist(), strict=True)), np.int64, len(word))
            here = (low[search] <= place) & ((place < high[search]) | (high[search] == short[search]))
            search, word = search[here], word[here]
        pairs.append((which[search], word))
    a, b = map(np.concatenate, zip(*pairs, strict=True))
    return a, b


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and best (minus its n, and the word): what is near each word that has near words."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if not rows:
            return
        counts = dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True))
        own = sorted(counts)
        places = {w: k for k, w in enumerate(own)}
        which = np.fromiter((places[w] for w in rows.column("word").to_pylist()), np.int64, len(rows))
        a, b = shard_pairs(own, which, *(rows.column(c).to_numpy().astype(np.int64) for c in ("short", "low", "high")))
        n = np.fromiter((counts[w] for w in own), np.int64, len(own))
        order = np.lexsort((b, -n[b], a))
        found, first, sizes = np.unique(a[order], return_index=True, return_counts=True)
        best = b[order][first]
        arrays = [pa.array([own[k] for k in found.tolist()], pa.string()), pa.array(sizes, pa.int64()), pa.array(n[best], pa.int64()), pa.array([own[k] for k in best.tolist()], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["word", "n_near", "near_n", "near"])

    rows = common.stored(searches(words), "searches")
    shards = 1 + (rows.agg(F.sum(F.char_length("word"))).first()[0] or 0) // SHARD
    found = rows.repartition(shards, "key").select("word", "n", "short", "low", "high").mapInArrow(shard, "word string, n_near long, near_n long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """word and root, from rows of word and root that are one step: twice as
    far in each round.  Forms are ever commoner, so chains are short and end."""
    while True:
        forms = common.stored(forms, "roots")
        on = forms.select(F.col("word").alias("at"), F.col("root").alias("further"))
        longer = forms.join(on, forms["root"] == on["at"])
        if longer.isEmpty():
            return forms
        forms = forms.join(on, forms["root"] == on["at"], "left").select("word", F.coalesce("further", "root").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the vocabulary.

    Null and empty texts have no words; a null id counts as the empty string
    in the rule of damage; repeated rows count as often as they are there; an
    empty table has no words.  Of near words as common as each other the
    smallest in code-point order is the form.  Other columns are not read.
    """
    words = common.stored(vocabulary(docs), "vocabulary")
    near_n = -F.col("best.minus")
    is_form = near_n >= COMMONER * F.col("n")
    found = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, near_n).alias("form_n"))
    found = common.stored(found, "forms")
    roots = rooted(found.where("form is not null").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
