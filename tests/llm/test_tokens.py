import base64
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from gutterline.llm import binary_index, byte_bpe, cutting_stock, packing, tokenizing
from gutterline.llm.tokenizing import byte_encoder, encode_whole, word_encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
vocabulary, PATTERN = public_tokenizers.path, public_tokenizers.PATTERN

WORD, BYTE, RANKS = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "a  b", "x\n\ny", "\n", "tab\tz ", "A b", "don't we'll", "é ́x", "日本語 テスト", "a\x1cb \x85 c", "<|endoftext|> hi", "ΑΣ ΣΑΣ", "foo.\nBar", " lead", "trail ", "a \n b", "12345 678", "😀😀 x", "\r\nq\r\n", "x, É. Été; y! ,", "I'S it's 'T a't."]


def texts():
    rnd = random.Random(5)
    return ODD + ["".join(rnd.choice(["a", "The ", " ", "\n", ",", "ñ", "'s", "9", "\t", "word", "é", ". "]) for _ in range(rnd.randint(0, 40))) for _ in range(400)]


def test_cached_words_give_the_library_s_ids():
    for path, encode in ((WORD, word_encoder(WORD, "<u2")), (BYTE, byte_encoder(BYTE, "<u2"))):
        for _ in range(2):  # the second time from the cache
            for text in texts():
                assert encode(text) == encode_whole(path, text, "<u2"), text


MARKED = ["this.### that, $$$ (x) a's don't. it'!s 'll x' \u00aa.. \u0149, \u024f! \u0250! re%%%\nSt. ***\n...x end...", "$$$", "x\n'll", "It's\nx", "a.b.c d-e f_g 1. 2,3 x9!", "<|endoftext|>", "a <|endoftext|> b", "\x00a b", "\nx", "x\n", "a\r\nb", "\ta b", "a\u2003 b", "a\u2003b c"]


@pytest.mark.parametrize("slice_bytes", [8 << 20, 50, 1])
def test_columns_give_the_library_s_ids(monkeypatch, slice_bytes):
    monkeypatch.setattr(tokenizing, "SLICE_BYTES", slice_bytes)
    column = [None, *texts(), *MARKED, None, *(a + b + c for a in ("", "a", "a. ", "\n") for b in MARKED + ODD for c in ("", " ", "\nB", "!"))]
    expected = [encode_whole(BYTE, t or "", "<u4") for t in column]
    encoder = byte_encoder.__wrapped__(BYTE, "<u4")
    for kind in (pa.string(), pa.large_string()):
        assert list(encoder.texts(pa.array(column, kind))) == expected
        assert list(encoder.texts(pa.array(column, kind).slice(3, 200))) == expected[3:203]
    for none_plain in ([], [None], ["", None], [" x", "y  z"]):
        assert list(encoder.texts(pa.array(none_plain, pa.string()))) == [encode_whole(BYTE, t or "", "<u4") for t in none_plain]


def test_odd_white_space_is_python_s():
    spaces = pa.array([chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    matched = pc.match_substring_regex(spaces, f"^{tokenizing.SPACE}$")
    assert spaces.filter(matched).to_pylist() == [s for s in spaces.to_pylist() if s.isspace()]


def test_a_column_s_words_are_encoded_once_and_by_the_merges_alone():
    encoder = byte_encoder.__wrapped__(BYTE, "<u4")
    pieces, wholes, lookups = [], [], []
    piece, whole, word = encoder.piece, encoder.whole, encoder.words.__getitem__
    encoder.piece = lambda match: pieces.append(match) or piece(match)
    encoder.whole = encoder.marks.encode = lambda text: wholes.append(text) or whole(text)

    class Counted(tokenizing.WordCache):
        def __getitem__(self, key):
            lookups.append(key)
            return super().__getitem__(key)

    encoder.words = Counted(encoder._part)
    assert list(encoder.texts(pa.array(["First, word word.### word\nLine word, word."] * 500))) == [encode_whole(BYTE, "First, word word.### word\nLine word, word.", "<u4")] * 500
    assert sorted(set(wholes)) == ["\n", ",", ".", ".###"] and len(wholes) == 4
    assert sorted(set(pieces)) == [" word", "First", "Line"] and pieces.count(" word") == pieces.count("Line") == 1
    assert len(lookups) < 20


def test_double_spaces_after_the_cache_was_full(monkeypatch):
    monkeypatch.setattr(tokenizing, "CACHE_WORDS", 8)
    encode = word_encoder.__wrapped__(WORD, "<u2")
    for text in [*texts(), "two  spaces", *texts()]:
        assert encode(text) == encode_whole(WORD, text, "<u2"), text


def test_byte_bpe_is_tiktoken_s():
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    theirs, ours = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), byte_bpe.coder(RANKS, PATTERN)
    for text in texts():
        ids = ours.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text), text
        assert ours.decode(ids) == text.encode()


def test_byte_bpe_of_odd_documents(odd, make):
    rows = byte_bpe.encode_documents(odd, RANKS, PATTERN).collect()
    assert len(rows) == 13 and sorted(bytes(r.decoded) for r in rows) == sorted((t.text or "").encode() for t in odd.collect())
    assert byte_bpe.digests(make().where("false"), RANKS, PATTERN).count() == 0


def test_perfect_hash():
    hashes = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    index = binary_index.PerfectHash.build(hashes)
    assert sorted(index.slots(hashes).tolist()) == list(range(5000))
    assert binary_index.PerfectHash.build(hashes[:0]).slots(hashes[:3]).tolist() == [-1] * 3


def test_keyed_access_and_foreign_keys():
    keys, null, lengths = np.array([0, 3, 9, 9]), np.array([1, 0, 0, 0], np.uint8), np.array([1, 2, 0, 3])
    shard = binary_index.Shard(binary_index.packed_shard(keys, null, lengths, np.arange(6, dtype="<u2").tobytes(), 2))
    assert shard.document(None).tolist() == [0] and shard.document(3).tolist() == [1, 2] and shard.document(9).tolist() == [] and shard.document(9, 1).tolist() == [3, 4, 5]
    assert shard.document(0) is None and shard.document(9, 2) is None and shard.document(12345) is None


@pytest.mark.parametrize(("per_shard", "per_range", "per_group"), [(2048, 4096, 1024), (2, 3, 2)])
def test_shards_of_odd_documents(odd, make, monkeypatch, per_shard, per_range, per_group):
    for name, value in (("DOCS_PER_SHARD", per_shard), ("DOCS_PER_RANGE", per_range), ("RANGES_PER_GROUP", per_group)):
        monkeypatch.setattr(binary_index, name, value)
    monkeypatch.setattr(binary_index.write_shards, "__defaults__", (per_shard, per_range))
    docs = odd.union(make(*((9, f"one id, many rows {i}") for i in range(20))))
    rows = sorted(binary_index.indexed_documents(docs, WORD).collect(), key=lambda r: r.start)
    expected = sorted((r.doc_id is not None, r.doc_id or 0, len(x), zlib.crc32(x.astype("<u4").tobytes())) for r in docs.collect() for x in [np.append(np.frombuffer(encode_whole(WORD, r.text or "", "<u2"), "<u2"), 2)])
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in rows) == expected
    assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == [e[:2] for e in expected]
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    assert len({(r.range, r.shard) for r in rows}) == (1 if per_shard > 2 else len({(r.range, r.shard) for r in rows})) and (per_shard > 2 or len({r.range for r in rows}) > 4)
    assert binary_index.indexed_documents(make().where("false"), WORD).count() == 0


def test_special_strings_are_the_library_s():
    from tokenizers import Tokenizer

    for path, encode in ((WORD, word_encoder(WORD, "<u2")), (BYTE, byte_encoder(BYTE, "<u2"))):
        plain = Tokenizer.from_file(path)
        for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "<|startoftext|> and < | endoftext |>"):
            assert np.frombuffer(encode(text), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


def check_packing(docs, rows, capacity=1024):
    """Every id once, no gaps in a sequence; the padding."""
    expected = {}
    for r in docs.collect():
        ids = np.append(np.frombuffer(encode_whole(BYTE, r.text or "", "<u4"), "<u4"), 0).astype("<u4")
        expected.setdefault(r.doc_id, []).append(ids)
    for doc_id, copies in expected.items():
        pieces = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        assert sum(r.length for r in pieces) == sum(map(len, copies))
        for r in pieces:
            assert any(r.doc_tokens == len(c) and zlib.crc32(c[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for c in copies)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    used = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        used.append(at)
    return sum(0 if packing.is_power_of_two(u) else capacity - u for u in used)


def test_packing_of_odd_documents(odd, make):
    docs = odd.where("doc_id is not null and doc_id <> 9")
    assert check_packing(docs, packing.packed(docs, BYTE).collect()) < 1024
    tokens = sum(len(encode_whole(BYTE, r.text or "", "<u4")) // 4 + 1 for r in odd.collect())
    assert packing.packed(odd, BYTE).selectExpr("sum(length)").first()[0] == tokens
    assert packing.packed(make().where("false"), BYTE).count() == 0


def test_packing_of_one_frequent_length(make):
    docs = make(*[(i, "word " * 599) for i in range(300)], *[(1000 + i, "a " * (i % 90)) for i in range(200)])
    assert check_packing(docs, packing.packed(docs, BYTE).collect()) < 1024 * 2


def histogram(n, seed, low=1, high=1024):
    rng = np.random.default_rng(seed)
    lengths, counts = np.unique(np.minimum(rng.lognormal(5.5, 1.0, n).astype(int) + low, high - 1), return_counts=True)
    return dict(zip(lengths.tolist(), counts.tolist(), strict=True))


def test_relaxation_is_optimal():
    """Against all patterns of a small instance, by weak duality and by hand."""
    used, cost = cutting_stock.column_generation(np.array([4, 6]), np.array([100, 100]), 10, gap=1e-9)
    assert abs(cost - 100) < 1 and dict(used[0][0]) == {0: 1, 1: 1}
    rng = np.random.default_rng(2)
    for _ in range(5):
        lengths = np.sort(rng.choice(np.arange(20, 60), 6, replace=False))
        demand = rng.integers(500, 5000, 6)
        used, cost = cutting_stock.column_generation(lengths, demand, 100, gap=1e-9)
        covered = np.zeros(6)
        for pattern, level in used:
            assert sum(lengths[k] * n for k, n in pattern.items()) <= 100
            for k, n in pattern.items():
                covered[k] += n * level
        assert (covered <= demand * (1 + 1e-5) + 1e-3).all()
        patterns = [p for p in itertools.product(range(6), repeat=6) if 0 < np.dot(p, lengths) <= 100]
        # the least cost over all patterns and the stream, by a multiplicative-weights bound from below
        prices = lengths / 100 + cutting_stock.CUT_COST
        matrix, best = np.array(patterns), 0.0
        y = prices / max((matrix @ prices).max(), 1.0)
        for _ in range(4000):
            best = max(best, float(y @ demand))
            worst = matrix[(matrix @ y).argmax()]
            y = np.minimum(y * np.exp(0.002 * (demand * y / (y @ demand) - worst * y)), prices)
            y /= max((matrix @ y).max(), 1.0)
        assert best <= cost + 1e-6 and cost <= best * 1.02


@pytest.mark.parametrize("times", [1, 100])
def test_patterns_do_the_packing(times):
    counts = {n: k * times for n, k in histogram(3000, 1).items()}
    plan = packing.packing_plan(counts)
    total = sum(n * k for n, k in counts.items())
    assert sum(plan.tokens) == total and plan.tokens[0] > (0.8 if times == 1 else 0.95) * total and plan.tokens[2] < 0.05 * total
    taken = dict.fromkeys(counts, 0)
    for n, first, copies, uses, _, _ in sorted(plan.uses):
        assert first == taken[n]
        taken[n] += copies * uses
    assert all(taken[n] == first <= counts[n] for n, first, _ in plan.stream)
    sequences = plan.first_stream_sequence + -(-plan.tokens[2] // 1024)
    assert sequences * 1024 - total <= 1024 + 0.005 * total


def test_knapsack_is_optimal():
    lengths, values = np.array([3, 5, 7]), np.array([2.0, 3.9, 5.0])
    best = max(2.0 * a + 3.9 * b + 5.0 * c for a in range(7) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 20)
    value, pattern = cutting_stock.best_pattern(values, lengths, 20)
    assert abs(value - best) < 1e-9 and abs(sum(values[k] * n for k, n in pattern.items()) - best) < 1e-9
