"""Operator 2: language identification by interpolated Kneser-Ney models.

One character model of order four is fitted for each language on a bounded
sample of passages, one group of rows for each language.  Models are stored
as sorted arrays of 64-bit n-gram hashes.  A text gets the language of lowest
cross-entropy per character.  Passages that were not fitted on calibrate two
things: the scale of the score, and the cross-entropy beyond which a text is
rejected, which is that of a text in a language that was not learned.
"""

from __future__ import annotations

import io
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDER = 4
#: The sample: passages in all (shared by the languages), their length in
#: characters, and one in how many is kept for calibration.
PASSAGES, PASSAGE_CHARS, CALIBRATE_EVERY = 1600, 2000, 4
#: Buckets in which a language's passages are ranked; a language that is learned
#: has one passage of each at least, so this many languages are learned at most.
BUCKETS = 16
MOST_LANGUAGES = PASSAGES // BUCKETS
#: Places whose sums are added up together, and those looked up at once.
SUMMED, LOOKED_UP = 1 << 19, 1 << 16
#: Characters that a text's posterior counts at most.
EVIDENCE_CHARS = 400
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code units of the texts' letters, lower-cased, with 0 for anything
    else, and the text each belongs to; runs of 0 are one, and each text is
    framed by 0."""
    joined = "\0" + "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _letters()[np.minimum(points, 0xFFFF)]
    of = np.repeat(np.arange(len(texts) + 1), [1, *(len(t) + 1 for t in texts)])
    of = np.maximum(of - 1, 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep].astype(np.uint64), of[keep]


_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _TABLE:
        table = np.zeros(1 << 16, np.uint16)
        for i in range(1 << 16):
            if (c := chr(i)).isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else i
        table[0xFFFF] = 0xFFFF  # every character beyond the first plane
        _TABLE.append(table)
    return _TABLE[0]


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """For each order 1..ORDER the n-gram that ends at each place, 16 bits a
    symbol; places before the first symbol are 0."""
    out = [codes]
    for n in range(1, ORDER):
        shifted = np.concatenate([np.zeros(min(n, len(codes)), np.uint64), codes[: max(len(codes) - n, 0)]])
        out.append(out[-1] | (shifted << np.uint64(16 * n)))
    return out


def hashed(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return keys * _MULTIPLIER  # odd, so no two n-grams share a hash


def scored_places(codes: np.ndarray) -> np.ndarray:
    """Every place but the leading frame of a text."""
    place = np.ones(len(codes), bool)
    if len(codes):
        place[0] = False
    return place


@dataclass
class Model:
    """Per order: n-grams (sorted), their interpolated probability, and as
    contexts (sorted) the weight left for the shorter context."""

    keys: list[np.ndarray]
    probability: list[np.ndarray]
    contexts: list[np.ndarray]
    weight: list[np.ndarray]
    floor: float

    @classmethod
    def fit(cls, codes: np.ndarray, alphabet: int) -> Model:
        """Interpolated Kneser-Ney: counts at the highest order, numbers of
        distinct predecessors below, absolute discounts n1 / (n1 + 2 n2)."""
        places = scored_places(codes)
        full = np.sort(grams(codes)[ORDER - 1][places])
        top, counts = np.unique(full, return_counts=True)
        levels = [(top, counts)]
        for n in range(ORDER - 1, 0, -1):
            mask = np.uint64((1 << 16 * n) - 1)
            levels.append(np.unique(levels[-1][0] & mask, return_counts=True))
        levels.reverse()
        floor = 1.0 / max(alphabet, 1)
        model = cls([], [], [], [], floor)
        for n, (keys, count) in enumerate(levels, 1):
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            context, index = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(index, count), np.bincount(index)
            weight = discount * kinds / total
            lower = np.full(len(keys), floor) if n == 1 else model.lookup(keys & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)
            model.keys.append(keys)
            model.probability.append(np.maximum(count - discount, 0) / total[index] + weight[index] * lower)
            model.contexts.append(context)
            model.weight.append(weight)
        return model

    def lookup(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Probability of each n-gram's last symbol after the others."""
        if n == 0:
            return np.full(len(keys), self.floor)
        at = np.minimum(np.searchsorted(self.keys[n - 1], keys), len(self.keys[n - 1]) - 1)
        out = self.probability[n - 1][at].copy()
        if (missing := self.keys[n - 1][at] != keys).any():
            rest = keys[missing]
            out[missing] = self.left(rest >> np.uint64(16), n) * self.lookup(rest & np.uint64((1 << 16 * (n - 1)) - 1), n - 1)
        return out

    def left(self, contexts: np.ndarray, n: int) -> np.ndarray:
        """What an unseen continuation keeps of the lower order's probability."""
        known = self.contexts[n - 1]
        at = np.minimum(np.searchsorted(known, contexts), len(known) - 1)
        return np.where(known[at] == contexts, self.weight[n - 1][at], 1.0)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, floor=self.floor, **{f"{name}{n}": x for name in ("keys", "probability", "contexts", "weight") for n, x in enumerate(getattr(self, name))})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Model:
        z = np.load(io.BytesIO(raw))
        return cls(*([z[f"{name}{n}"] for n in range(ORDER)] for name in ("keys", "probability", "contexts", "weight")), float(z["floor"]))


class Identifier:
    """All languages' models, joined: for each order the sorted hashes of the
    n-grams of any language with a column of log probabilities for each."""

    def __init__(self, models: dict[str, bytes]) -> None:
        self.langs = sorted(models)
        loaded = [Model.load(models[lang]) for lang in self.langs]
        self.keys, self.log_p, self.contexts, self.log_left = [], [], [], []
        for n in range(1, ORDER + 1):
            self._join(n, np.unique(np.concatenate([m.keys[n - 1] for m in loaded])), [m.lookup for m in loaded], self.keys, self.log_p)
            self._join(n, np.unique(np.concatenate([m.contexts[n - 1] for m in loaded])), [m.left for m in loaded], self.contexts, self.log_left)
        self.log_floor = np.log(np.array([m.floor for m in loaded], np.float32))

    @staticmethod
    def _join(n: int, keys: np.ndarray, of, hashes: list, values: list) -> None:
        order = np.argsort(hashed(keys))
        hashes.append(hashed(keys)[order])
        values.append(np.stack([np.log(f(keys, n)) for f in of], axis=1).astype(np.float32)[order])

    def log_probability(self, parts: list[np.ndarray], n: int = ORDER) -> np.ndarray:
        """One row for each place: the log probability under each language."""
        if n == 0:
            return np.broadcast_to(self.log_floor, (len(parts[0]), len(self.langs)))
        known, wanted = self.keys[n - 1], hashed(parts[n - 1])
        at = np.searchsorted(known, wanted)
        np.minimum(at, len(known) - 1, out=at)
        out = self.log_p[n - 1][at]
        if (missing := known[at] != wanted).any():
            rest = [p[missing] for p in parts[:n]]
            contexts, wanted = self.contexts[n - 1], hashed(rest[n - 1] >> np.uint64(16))
            at = np.minimum(np.searchsorted(contexts, wanted), len(contexts) - 1)
            left = np.where((contexts[at] == wanted)[:, None], self.log_left[n - 1][at], np.float32(0))
            out[missing] = left + self.log_probability(rest, n - 1)
        return out

    def _places(self, codes: np.ndarray, first: int, last: int) -> np.ndarray:
        """Log probabilities at the places from ``first`` to before ``last``, few at once."""
        out = np.empty((last - first, len(self.langs)), np.float32)
        for a in range(first, last, LOOKED_UP):
            b, lead = min(a + LOOKED_UP, last), min(a, ORDER - 1)
            out[a - first : b - first] = self.log_probability([p[lead:] for p in grams(codes[a - lead : b])])
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text under each language, and the
        number of characters; infinite where a text has no letter."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for first, last in _slices(texts):
            codes, of = symbols(texts[first:last])
            for a in range(0, len(codes), SUMMED):
                log_p = self._places(codes, max(a, 1), min(a + SUMMED, len(codes)))
                where = of[max(a, 1) : a + SUMMED]
                for k in range(len(self.langs)):
                    total[first:last, k] -= np.bincount(where, log_p[:, k], last - first)
                n[first:last] += np.bincount(where, minlength=last - first)
        letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        return np.where(letters[:, None], total / np.maximum(n, 1)[:, None], np.inf), np.where(letters, n, 0)


def _slices(texts: list[str]):
    """Runs of texts of about a million characters."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > 1 << 20:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


@dataclass
class Calibration:
    """usual, between, within: a text of n characters in a learned language
    has a cross-entropy of about ``usual`` with variance between + within / n;
    foreign: what learned languages score on each other's text."""

    usual: float
    between: float
    within: float
    foreign: float
    scale: float

    def limit(self, n: np.ndarray) -> np.ndarray:
        return np.maximum(self.usual + 6 * np.sqrt(self.between + self.within / np.maximum(n, 1)), self.foreign + 6 * np.sqrt(self.within / np.maximum(n, 1)))


def posterior(entropy: np.ndarray, n: np.ndarray, scale: float) -> np.ndarray:
    """The best language's share of the evidence."""
    evidence = -np.where(np.isfinite(entropy), entropy, 0) * (np.minimum(n, EVIDENCE_CHARS) * scale)[:, None]
    share = np.exp(evidence - evidence.max(1, keepdims=True))
    return share.max(1) / share.sum(1)


def calibrate(identifier: Identifier, texts: list[str], langs: list[str]) -> Calibration:
    """Fit on labelled passages that the models have not seen."""
    entropy, n = identifier.entropies(texts)
    good = n > 0
    if not good.any():
        return Calibration(np.inf, 0, 0, np.inf, 1)
    entropy, n, truth = entropy[good], n[good], np.array([identifier.langs.index(x) for x in langs])[good]
    own = entropy[np.arange(len(n)), truth]
    usual, within = float(np.median(own)), float(np.median((own - np.median(own)) ** 2 * n) / 0.455)
    long = n >= np.median(n)
    between = float(np.var(own[long]))
    others = np.where(np.eye(len(identifier.langs), dtype=bool)[truth], np.inf, entropy).min(1)
    foreign = float(np.median(others)) if len(identifier.langs) > 1 else usual + 1.0
    best = entropy.argmin(1) == truth
    loss = lambda s: -np.log(np.clip(np.where(best, p := posterior(entropy, n, s), 1 - p), 1e-6, None)).mean()
    scale = min((2.0**k / 16 for k in range(0, 9)), key=loss)
    return Calibration(usual, between, within, foreign, scale)


def even_share(counts: list[int], total: int) -> int:
    """The most that each may have if ``total`` is shared evenly and none gets more than its count."""
    share = total
    for n, count in enumerate(sorted(counts)):
        share = total // (len(counts) - n)
        if count >= share:
            break
        total -= count
    return share


def sampled_passages(labelled: DataFrame) -> DataFrame:
    """A bounded sample of (lang, passage, at): at most ``PASSAGES`` rows,
    shared evenly by the languages, what one of few rows leaves going to the
    others, each one passage of a text at a place that a hash of the row
    chooses.  Of more than ``MOST_LANGUAGES`` values of
    lang, as a dirty column has, those of most rows are learned (of equal ones
    the first by name)."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "lang").alias("at"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    rows = rows.where(F.col("lang").isin(list(counts)))
    each = even_share(list(counts.values()), PASSAGES) // BUCKETS
    # ranked within buckets of a language, so a frequent one is spread; the
    # limit is applied before the shuffle as well
    start = F.pmod(F.shiftright("at", 16), F.greatest(F.char_length("text") - PASSAGE_CHARS, F.lit(0)) + 1) + 1
    passages = rows.select("lang", "at", F.pmod("at", F.lit(BUCKETS)).alias("bucket"), F.col("text").substr(start.cast("int"), F.lit(PASSAGE_CHARS)).alias("passage"))
    rank = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("at", "passage"))
    return passages.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "passage", "at", "rank")


def fitted(labelled: DataFrame) -> tuple[dict[str, bytes], Calibration]:
    """Models of all languages, stored in the shared folder, and the
    calibration; both are bounded by the sample."""
    sample = common.stored(sampled_passages(labelled), "passages")
    alphabet = 64

    def fit(key, rows):
        train = rows[rows["rank"] % CALIBRATE_EVERY != 0] if (rows["rank"] % CALIBRATE_EVERY != 0).any() else rows
        codes, _ = symbols(train.sort_values(["at", "passage"])["passage"].tolist())
        return pd.DataFrame({"lang": [key[0]], "model": [Model.fit(codes, max(alphabet, len(np.unique(codes)))).dump()]})

    models = common.stored(sample.groupBy("lang").applyInPandas(fit, "lang string, model binary"), "models")
    found = {r.lang: bytes(r.model) for r in models.collect()}
    if not found:
        return {}, Calibration(np.inf, 0, 0, np.inf, 1)
    held = sample.where(F.col("rank") % CALIBRATE_EVERY == 0).select("lang", "passage").orderBy("lang", "passage").collect()  # a quarter of the sample
    held = held or sample.select("lang", "passage").orderBy("lang", "passage").collect()
    return found, calibrate(Identifier(found), [r.passage for r in held], [r.lang for r in held])


def predicted(spark, models: dict[str, bytes], calibration: Calibration, text: Column) -> Column:
    """A struct of lang_pred, score, rejected, cross_entropy for a text column."""
    shared, key = spark.sparkContext.broadcast(models), uuid.uuid4().hex

    @F.arrow_udf("lang_pred string, score double, rejected boolean, cross_entropy double")
    def predict(texts: pa.Array) -> pa.Array:
        if shared.value:
            identifier = common.resident(key, lambda: Identifier(shared.value))
            entropy, n = identifier.entropies([t or "" for t in texts.to_pylist()])
            best, score = entropy.argmin(1), posterior(entropy, n, calibration.scale)
            lowest = entropy[np.arange(len(n)), best]
            known = n > 0
            lang = pa.array([identifier.langs[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)], pa.string())
            rejected = ~known | (lowest > calibration.limit(n))
            fields = [lang, pa.array(np.where(known, score, 0.0)), pa.array(rejected), pa.array(lowest, mask=~known)]
        else:
            size = len(texts)
            fields = [pa.array(["und"] * size, pa.string()), pa.array(np.zeros(size)), pa.array(np.ones(size, bool)), pa.nulls(size, pa.float64())]
        return pa.StructArray.from_arrays(fields, ["lang_pred", "score", "rejected", "cross_entropy"])

    return predict(text)


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected, cross_entropy.

    Fitted on a sample of the rows with a language that are not held out.  A
    null text, or one without letters, is ``und``, score 0 and rejected; with
    no labelled row every text is.  A rejected text keeps the language that
    was nearest.  Null ids are not held out; repeated rows pass through; other
    columns are not read.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    models, calibration = fitted(docs.where(~held_out()).select("doc_id", "lang", "text"))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), predicted(spark, models, calibration, F.col("text")).alias("p"))
    return marked.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected", "p.cross_entropy")


def without_rejected(docs: DataFrame) -> DataFrame:
    """The documents that some learned language accounts for, columns as they are.

    Null texts, and those without a letter, go; null ids and repeated rows
    stay as they are; with no labelled row every document goes; an empty table
    stays empty.  What a text is decides alone, so ties don't occur.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    models, calibration = fitted(docs.where(~held_out()).select("doc_id", "lang", "text"))
    name = common.unused(docs, "predicted")
    return docs.withColumn(name, predicted(spark, models, calibration, F.col("text"))).where(~F.col(name)["rejected"]).drop(name)
