"""Operator 10: byte-level BPE encoding and decoding through sentencepiece.

A sentencepiece BPE model is serialised straight from the rank vocabulary:
each piece is the token's bytes, every byte written as one printable
character, scored by its negative rank, with identity normalisation.  Merging
the pair of best score is then merging the pair of lowest rank.  Each match
of the split pattern is encoded on its own; a match that is itself a token is
that token.  Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import functools
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .tokenizing import AttachedSpaceEncoder, byte_characters


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field in protobuf's wire format."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialised_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: ``tokens`` in order of rank, then one unknown piece."""
    to_char = byte_characters()
    pieces = [_field(1, "".join(to_char[b] for b in t).encode()) + _field(2, -float(rank)) + _field(3, 1) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, "⁇unknown⁇".encode()) + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, 2**64 - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encodes texts to rank ids and decodes ids to bytes."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        ordered = sorted(ranks, key=ranks.__getitem__)
        self.ranks, self.rank_of_piece = ranks, np.array([ranks[t] for t in ordered], dtype="<u4")
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.to_char = byte_characters()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(ordered))
        self.matches = regex.compile(pattern).findall
        self.encode = AttachedSpaceEncoder(self.encode_matches, lambda match: np.array(self.encode_match(match), dtype="<u4").tobytes())

    def encode_match(self, match: str) -> list[int]:
        raw = match.encode("utf-8", "surrogatepass")
        if (rank := self.ranks.get(raw)) is not None:
            return [rank]
        chars = self.to_char
        return self.rank_of_piece[self.model.encode("".join([chars[b] for b in raw]))].tolist()

    def encode_matches(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; ``encode``
        gives the same and remembers words."""
        return np.array([i for m in self.matches(text) for i in self.encode_match(m)], dtype="<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.cache
def coder(ranks_path: str, pattern: str) -> ByteBpe:
    """One coder for each Python worker."""
    return ByteBpe(ranks_path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every whole text and decode it again.

    Returns id, n_tokens, ids (binary, little-endian 32-bit), decoded
    (binary).  A null text is an empty one: no ids, no bytes.  Repeated rows
    and null ids pass through; other columns are not read.
    """
    common.small_batches(docs.sparkSession)

    def encode(batches):
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.binary())],
                names=[id_column, "n_tokens", "ids", "decoded"],
            )

    return docs.select(id_column, text_column).mapInArrow(encode, f"`{id_column}` long, n_tokens long, ids binary, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encode_documents``,
    digested by Spark."""
    from pyspark.sql import functions as F

    coded = encode_documents(docs, ranks_path, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
