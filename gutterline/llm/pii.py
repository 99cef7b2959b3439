"""Operator 3: personal data, also in disguise, with offsets into the source.

Transducers rewrite a text step by step (look-alike characters, bracketed or
spelled "at" and "dot", spelled digits); each keeps, for every character it
writes, the span of source characters that it stands for.  Identifiers are
found in the source text and in the rewritten one; a span found only there is
mapped back to the source.
"""

from __future__ import annotations

import bisect
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")

# Characters that look like ASCII ones and have no compatibility form.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ո": "n", "к": "k", "м": "m", "т": "t", "в": "b", "г": "r", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ε": "e", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    "ı": "i", "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".", "•": ".", "∙": ".",
}
# Words for digits in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Words for the signs, and last labels after which a spelled address counts.
AT, DOT, PLUS = "at|arroba|arobase|klammeraffe", "dot|punto|point|punkt", "plus|más"
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|co|me|dev|app|ai|eu|uk|us|ca|au|de|at|ch|fr|be|es|mx|ar|it|nl|pt|br|in|jp|cn|test|example|invalid|local"

_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_UNIT = rf"(?:\b(?:{_WORD})\b|[0-9])"
#: At least four digits in a row, spelled or not, at least two of them spelled.
SPELLED = re.compile(rf"(?i)(?:\b(?:{PLUS})[ \t]+)?\b{_UNIT}(?:(?:[ \t]*(?:[-,.()]|\b(?:{DOT})\b)[ \t]*|[ \t]+){_UNIT}|(?<=[0-9])[0-9])+")
SPELLED_HINT = re.compile(rf"(?i)\b(?:{_WORD})(?:[ \t,.()-]+|[ \t]+(?:{DOT})[ \t]+)(?:{_WORD}|[0-9])\b")
DIGIT_WORD = re.compile(rf"(?i)\b(?:{_WORD})\b")
SPELLED_PIECE = re.compile(rf"(?i)\b(?:{_WORD})\b|\b(?:{DOT})\b|\b(?:{PLUS})\b|[ \t,-]+")
BRACKETED = re.compile(rf"(?i)(?<![ \t])[ \t]*+[\[({{<][ \t]*+(?:(@|{AT})|(\.|{DOT}))[ \t]*[\])}}>][ \t]*")
#: An "at", spelled or not; a spelled dot at the end of what comes in front of
#: it; and the labels that follow.
AT_SIGN = re.compile(rf"(?i)(?:(?<![ \t])[ \t]++(?:{AT}|@)[ \t]++|@)(?=[a-z0-9-]*\b)")
_SPELLED_DOT = rf"[ \t]{{1,4}}(?:{DOT}|\.)[ \t]{{1,4}}"
DOT_BEFORE = re.compile(rf"(?i)[ \t]{{1,4}}(?:{DOT})[ \t]{{1,4}}\Z")
DOMAIN_PARTS = re.compile(rf"(?i)[a-z0-9-]+(?:(?:{_SPELLED_DOT}|\.)[a-z0-9-]+)*(?:{_SPELLED_DOT}|\.)(?:(?:{ENDINGS})|[a-z]{{2}})\b")
#: Characters that hold the longest match of ``DOT_BEFORE``.
DOT_CHARS = 8 + max(map(len, DOT.split("|")))
MAIL_SIGN = re.compile(rf"(?i)(?<![ \t])[ \t]++(?:({AT}|@)|({DOT}|\.))[ \t]++")
# Words that can't be the first label of a spelled address.
NO_LABELS = frozenset("the a an this that every each his her its my our your their le la les el los las un una une der die das ein eine".split())
SPELLED_DOTS = re.compile(rf"(?i)\b[0-9]+(?:[ \t]+(?:{DOT})[ \t]+[0-9]+){{3}}\b")
_SEPARATORS = str.maketrans("-,.()\n\t", "       ")
_DOTS, _DIGIT_SET, _ENDINGS = DOT.split("|"), frozenset(DIGIT_WORDS), frozenset(ENDINGS.split("|"))
INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
NOT_PLAIN = re.compile("[^\x00-ɏ]|·|­")


def ascii_form(char: str) -> str:
    """The ASCII character that ``char`` imitates, or ``char``."""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if (digit := unicodedata.digit(char, None)) is not None and not "²" <= char <= "¹" and char not in "²³":
        return str(digit)
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and plain.isascii() and ord(char) > 0x24F else char


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(map(int, reversed(digits))):
        d *= 1 + place % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def find(text: str) -> list[tuple[int, int, int]]:
    """Base spans (start, kind, end), each kind leftmost and non-overlapping.

    In time linear in the text: an address is sought from its ``@``, and no
    pattern is tried again inside a run of digits.
    """
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            out.append((start, 0, domain.end()))
            free = domain.end()
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(part) < 4 and int(part) <= 255 for part in (p.lstrip("0") or "0" for p in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Rewritten:
    """A text with, for each character, the source span it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.changed = text, np.zeros(len(text), bool)
        self.start = np.arange(len(text))
        self.end = self.start + 1

    def translate(self) -> None:
        """One character for another: offsets stay."""
        text = NOT_PLAIN.sub(lambda m: ascii_form(m[0]), self.text)
        for m in NOT_PLAIN.finditer(self.text):
            self.changed[m.start()] = text[m.start()] != m[0]
        self.text = text

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Write ``new`` for each (start, end, new), in order and none
        overlapping; its characters stand for the whole stretch.  One pass."""
        if not edits:
            return
        parts, at, news = [], 0, []
        for a, b, new in edits:
            parts += (self.text[at:a], new)
            news.append(len(new))
            at = b
        parts.append(self.text[at:])
        starts, ends, news = np.array([e[0] for e in edits]), np.array([e[1] for e in edits]), np.array(news)
        # how often each character is written: stretches not at all, their first new characters in place of them
        gaps = starts - np.concatenate([[0], ends[:-1]])
        kept = np.ones(len(self.text), bool)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            kept[a:b] = False
        places = np.repeat(np.cumsum(gaps), news)  # where, among the kept characters, new ones go
        stretch_start, stretch_end = np.repeat(self.start[starts], news), np.repeat(self.end[ends - 1], news)
        self.text = "".join(parts)
        self.start = np.insert(self.start[kept], places, stretch_start)
        self.end = np.insert(self.end[kept], places, stretch_end)
        self.changed = np.insert(self.changed[kept], places, True)

    def replace(self, pattern: re.Pattern, by) -> None:
        self.rewrite([(m.start(), m.end(), by(m)) for m in pattern.finditer(self.text)])


def _spelled_piece(m: re.Match) -> str:
    word = m[0].lower()
    if word in DIGIT_WORDS:
        return DIGIT_WORDS[word]
    return "" if not word.strip(" \t,-") else "+" if re.fullmatch(PLUS, word) else "."


def _pieces(text: str, within: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Edits that read the spelled digits and signs of some stretches."""
    return [(m.start(), m.end(), _spelled_piece(m)) for a, b in within for m in SPELLED_PIECE.finditer(text, a, b)]


def local_part(text: str, end: int, free: int) -> tuple[int, int]:
    """Where the local part that ends at ``end`` begins, spelled dots taken for
    dots, and where its last piece does; both are ``end`` if there is none.
    Not before ``free``."""

    def back(at: int) -> int:
        while at > free and text[at - 1] in LOCAL:
            at -= 1
        return at

    begin = last = back(end)
    while begin < end and (dot := DOT_BEFORE.search(text, max(free, begin - DOT_CHARS), begin)) and (further := back(dot.start())) < dot.start():
        begin = further
    return begin, last


def spelled_mails(text: str) -> list[tuple[int, int]]:
    """Stretches that read as an address with a spelled sign, leftmost first.

    Sought from the "at", so in time linear in the text: neither what is read
    back from it nor what follows it goes beyond the next "at".
    """
    out, free = [], 0
    for sign in AT_SIGN.finditer(text):
        if sign.start() < free or not (domain := DOMAIN_PARTS.match(text, sign.end())):
            continue
        begin, last_piece = local_part(text, sign.start(), free)
        if last_piece == sign.start():
            continue
        signs = "@" in sign[0], re.search(rf"(?i)[ \t](?:{DOT})[ \t]", domain[0]) is not None
        first = re.match(r"[a-zA-Z0-9-]*", domain[0])[0].lower()
        last = re.search(r"[a-zA-Z]+\Z", domain[0][-80:])[0].lower()
        # a plain pair of words around "at" is prose unless the dot gives it away
        if not (signs[0] or signs[1]) or first in NO_LABELS or not MAIL_SIGN.search(text, sign.start(), domain.end()) and begin == last_piece:
            continue
        if last not in _ENDINGS and not signs[1]:
            continue
        out.append((begin if signs[1] else last_piece, domain.end()))
        free = domain.end()
    return out


def undisguised(text: str) -> Rewritten | None:
    """The text as its disguises are meant to be read; None if there are
    none.  Each transducer passes over the text once."""
    out = Rewritten(text)
    if not text.isascii() and NOT_PLAIN.search(text):
        out.translate()
        out.replace(INVISIBLE, lambda m: "")
    lower = out.text.lower()
    if any(opening in lower for opening in "[({<"):
        out.replace(BRACKETED, lambda m: "@" if m[1] else ".")
    dotted = any(word in lower for word in _DOTS)
    if not _DIGIT_SET.isdisjoint(lower.translate(_SEPARATORS).split()) and SPELLED_HINT.search(out.text):
        within = []
        for m in SPELLED.finditer(out.text):
            words = len(DIGIT_WORD.findall(m[0]))
            if words >= 2 and words + sum(map(str.isdigit, m[0])) >= 4:
                within.append(m.span())
        out.rewrite(_pieces(out.text, within))
    if dotted:
        out.rewrite(_pieces(out.text, [m.span() for m in SPELLED_DOTS.finditer(out.text)]))
    if "@" in out.text or dotted:
        out.rewrite([(m.start(), m.end(), "@" if m[1] else ".") for a, b in spelled_mails(out.text) for m in MAIL_SIGN.finditer(out.text, a, b)])
    return out if out.changed.any() or len(out.text) != len(text) else None


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those that only the rewritten text shows; where one of
    these meets a base span it is of the same kind and goes beyond it."""
    base = find(text)
    meant, more = undisguised(text), []
    if meant:
        by_kind = [[(a, b) for a, k, b in base if k == kind] for kind in range(len(KINDS))]
        ends = [[b for _, b in found] for found in by_kind]

        def met(kind: int, start: int, end: int):
            """Base spans of a kind that a stretch meets: they are in order and don't overlap."""
            at = bisect.bisect_right(ends[kind], start)
            while at < len(ends[kind]) and by_kind[kind][at][0] < end:
                yield by_kind[kind][at]
                at += 1

        changes = np.concatenate([[0], np.cumsum(meant.changed)])
        for a, kind, b in find(meant.text):
            start, end = int(meant.start[a]), int(meant.end[b - 1])
            if changes[b] == changes[a] and end - start == b - a:
                continue
            if all(k == kind or next(met(k, start, end), None) is None for k in range(len(KINDS))) and all(start <= x[0] and x[1] <= end and x[1] - x[0] < end - start for x in met(kind, start, end)):
                more.append((start, kind, end))
    return base, sorted(set(more))


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in found)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the digest are those of the base spans; ``spans`` also has
    the n_added disguised ones, by start and kind.  Offsets are code points, ends
    exclusive.  A null text is empty; repeated rows and null ids pass through;
    other columns are not read.
    """
    common.small_batches(docs.sparkSession)

    def rows(batches):
        for batch in batches:
            found = [spans(t or "") for t in batch.column(1).to_pylist()]
            count = lambda kind: pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64())  # noqa: E731,B023
            arrays = [batch.column(0), *map(count, range(4)), pa.array([written(base) for base, _ in found]), pa.array([written(sorted(base + more)) for base, more in found]), pa.array([len(more) for _, more in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string, n_added long")
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def masked(text: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of
    spans that overlap, the union is one mask of the first one's kind."""

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            if text:
                base, more = spans(text)
                merged: list[list[int]] = []
                for a, kind, b in sorted(base + more):
                    if merged and a < merged[-1][2]:
                        merged[-1][2] = max(merged[-1][2], b)
                    else:
                        merged.append([a, kind, b])
                parts, at = [], 0
                for a, kind, b in merged:
                    parts += (text[at:a], f"<{KINDS[kind].upper()}>")
                    at = b
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pa.array(out, pa.string())

    return mask(text)


def mask_documents(docs: DataFrame) -> DataFrame:
    """The documents with their text masked and n_chars brought up to date;
    other columns stay."""
    common.small_batches(docs.sparkSession)
    hidden = docs.withColumn("text", masked(F.col("text")))
    return hidden.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))) if "n_chars" in docs.columns else hidden
