"""Exact tokenisation of whole texts that looks repeated words up.

Both tokenizers split a text at white space before any merge, so the ids of a
text are the ids of its words in a row.  A worker keeps the ids of the words
it has met; the tokenizers library encodes what is new, and whole texts
wherever a text has white space that the split does not cover, or the string
of a special token.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Words that one worker remembers, and the longest that it remembers.
CACHE_WORDS = 700_000
CACHE_CHARS = 48
#: Bytes of text whose words are looked up together; a worker needs some ten times as many meanwhile.
SLICE_BYTES = 1 << 20
#: White space as Python has it, and what of it makes a text ``Unsplittable``.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNSPLITTABLE = rf"^(?:[ \n]|$)|[ \n]{SPACE}|{SPACE}(?:[ \n]|$)"


class Unsplittable(Exception):
    """A piece begins or ends in white space: its text is encoded whole."""


class WordCache(dict):
    """Ids of a word as bytes; ``encode(word) -> bytes`` fills in what is missing."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


def byte_characters() -> list[str]:
    """One printable character for each byte; none is white space."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printable)]
    return [chr(b) if b in set(printable) else chr(256 + others.index(b)) for b in range(256)]


def plain_stem(word: str) -> bool:
    """Whether a word is Latin letters only, and so one piece of the pattern's."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


def stem_and_mark(word: str) -> tuple[str, str] | None:
    """A plain stem and the one mark behind it: two pieces of the pattern's."""
    return (word[:-1], word[-1]) if word[-1:] in ".,;:!?" and plain_stem(word[:-1]) else None


#: ASCII marks without the apostrophe, which contractions start with.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def stem_and_marks(word: str) -> tuple[str, str] | None:
    """A plain stem and the marks behind it, if any: a byte-level pattern has all of them as one piece."""
    stem = word.rstrip(MARKS)
    return (stem, word[len(stem) :]) if plain_stem(stem) else None


def attached_parts(text: str) -> tuple[str, list[str]]:
    """The text cut in front of each single space or line break.

    The first part stands as it is; each other part lost the space in front
    of it, unless it starts with its line break.
    """
    first, *rest = text.replace("\n", " \n").split(" ")
    return first, rest


def attached_word(part: str) -> str:
    """The piece of text that ``part`` stands for.

    Raises Unsplittable where white space touches the cut, since a run of
    white space is one piece of the pattern's.
    """
    word = part if part[:1] == "\n" else " " + part
    if len(word) < 2 or word[1].isspace() or word[-1].isspace():
        raise Unsplittable
    return word


@functools.cache
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def specials(path: str) -> tuple[str, ...]:
    """Strings that the library looks for before it splits a text."""
    return tuple(token.content for token in library(path).get_added_tokens_decoder().values())


def encode_whole(path: str, text: str, dtype: str) -> bytes:
    return np.array(library(path).encode(text, add_special_tokens=False).ids, dtype=dtype).tobytes()


class DroppedSpaceEncoder:
    """For a tokenizer that lower-cases, drops white space and never looks across it."""

    def __init__(self, path: str, dtype: str) -> None:
        self.path, self.dtype, self.model, self.specials = path, dtype, library(path).model, specials(path)
        self.words = WordCache(self._word)
        dict.__setitem__(self.words, "", b"")

    def _word(self, word: str) -> bytes:
        if word.isascii():
            if (lower := word.lower()) != word:
                return self.words[lower]
            if cut := stem_and_mark(word):
                return self.words[cut[0]] + self.words[cut[1]]
            if word.isalpha():  # no step before the merges changes it
                return np.array([t.id for t in self.model.tokenize(word)], dtype=self.dtype).tobytes()
        return encode_whole(self.path, word, self.dtype)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return encode_whole(self.path, text, self.dtype)
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


class AttachedSpaceEncoder:
    """For a byte-level tokenizer whose pieces start with the space before them.

    ``whole`` encodes any text, ``piece`` a text that is one match of the
    pattern's; a text that holds one of ``specials`` is encoded whole.
    """

    def __init__(self, whole, piece=None, specials: tuple[str, ...] = ()) -> None:
        self.whole, self.piece, self.specials = whole, piece or whole, specials
        self.words = WordCache(self._part)
        self.marks = WordCache(whole)

    def _part(self, part: str) -> bytes:
        word = attached_word(part)
        if word[0] == " ":
            if cut := stem_and_mark(part):
                return self.words[cut[0]] + self.marks[cut[1]]
            if plain_stem(part):
                return self.piece(word)
        return self.whole(word)

    def __call__(self, text: str) -> bytes:
        first, rest = attached_parts(text)
        try:
            if first == "" or first[-1].isspace() or any(s in text for s in self.specials):
                raise Unsplittable
            return self.whole(first) + b"".join(map(self.words.__getitem__, rest))
        except Unsplittable:
            return self.whole(text)


class ByteLevelEncoder(AttachedSpaceEncoder):
    """Encodes whole columns: of many texts at once, each word is looked up once.

    A line break and the word behind it have to be matches of their own.
    """

    def _part(self, part: str) -> bytes:
        if cut := stem_and_marks(part):
            stem, marks = cut
            return self.words[stem] + self.marks[marks] if marks else self.piece(" " + stem)
        word = attached_word(part)
        return self.marks["\n"] + self._head(word[1:]) if word[0] == "\n" else self.whole(word)

    def _head(self, word: str) -> bytes:
        """A word with no space in front of it."""
        if cut := stem_and_marks(word):
            stem, marks = cut
            return self.piece(stem) + self.marks[marks] if marks else self.piece(stem)
        return self.whole(word)

    def texts(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text; null is empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(column).to_numpy())
        cuts = np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1
        for a, b in itertools.pairwise([0, *cuts.tolist(), len(column)]):
            yield from self._slice(column.slice(a, b - a))

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        odd = pc.match_substring_regex(texts, UNSPLITTABLE)
        for special in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        cut = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n"), " ")
        parts, starts = cut.flatten(), cut.offsets.to_numpy()
        behind = np.ones(len(parts), bool)
        behind[starts[:-1]] = False
        words = parts.filter(pa.array(behind)).dictionary_encode()
        known = pa.array(map(self.words.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)), pa.large_binary())
        tails = pc.binary_join(pa.ListArray.from_arrays(starts - np.arange(len(starts), dtype=np.int32), known.take(words.indices)), pa.scalar(b"", pa.large_binary()))
        whole, split = iter(texts.filter(odd).to_pylist()), zip(parts.take(pa.array(starts[:-1])).to_pylist(), tails.to_pylist(), strict=True)
        for is_odd in odd.to_pylist():
            if is_odd:
                yield self.whole(next(whole))
            else:
                first, tail = next(split)
                yield self._head(first) + tail


def _resident(build):
    """One for each Python worker, until it needs something else."""

    @functools.wraps(build)
    def kept(*args):
        return common.resident((build.__name__, *args), lambda: build(*args))

    return kept


@_resident
def word_encoder(path: str, dtype: str) -> DroppedSpaceEncoder:
    return DroppedSpaceEncoder(path, dtype)


@_resident
def byte_encoder(path: str, dtype: str) -> ByteLevelEncoder:
    """A single match goes to the library's merges, its bytes as characters."""
    merges, chars, code = library(path).model.tokenize, byte_characters(), np.dtype(dtype).char

    def piece(match: str) -> bytes:
        mapped = match.replace(" ", chars[32]) if match.isascii() else "".join([chars[b] for b in match.encode()])
        ids = [t.id for t in merges(mapped)]
        return struct.pack(f"<{len(ids)}{code}", *ids)

    return ByteLevelEncoder(lambda text: encode_whole(path, text, dtype), piece, specials(path))
