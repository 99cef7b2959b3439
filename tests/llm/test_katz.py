import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gutterline.llm import katz


def rows(n=150):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rnd.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=rnd.randint(0, 60)))) for i in range(n)] + [(n, None), (n + 1, "New words, ONLY here"), (n + 2, "w0\tW1\nw2\x0bw3"), (None, "w1 w2")]


def direct(docs, order=2):
    """The scores by plain dictionaries; also the model."""
    tokens = [(t or "").encode().lower().split() + [None] for _, t in docs]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    # an n-gram's context never reaches beyond the start of a text
    grams = lambda t, n: [tuple((["<"] + t)[max(0, i + 2 - n) : i + 2]) for i in range(len(t))]
    tables = [Counter(g for t, h in zip(tokens, held, strict=True) if not h for g in (grams(t, n) if n > 1 else [(w,) for w in t])) for n in range(1, order + 1)]
    ratios = [katz.Discounts.good_turing([Counter(c.values())[i] for i in range(1, katz.DISCOUNTED + 2)]) for c in tables]
    less = lambda d, r: r * (d.ratio[r] if r <= katz.DISCOUNTED else 1.0)
    words = {w: c for (w,), c in tables[0].items()}
    total = sum(words.values())
    unknown = 1 - sum(less(ratios[0], c) for c in words.values()) / total
    of, kept, below = ([Counter() for _ in range(order + 1)] for _ in range(3))

    def weight(n, h):
        return (1 - kept[n][h] / of[n][h]) / (1 - below[n][h]) if of[n][h] else 1.0

    def p(n, h, w):
        """The probability of w after h, the n - 1 tokens before it, or fewer from the start."""
        if n == 1:
            return less(ratios[0], words[w]) / total if words.get(w) else unknown
        if r := tables[n - 1][(*h, w)]:
            return less(ratios[n - 1], r) / of[n][h]
        return weight(n, h) * p(n - 1, shorter(n, h), w)

    def shorter(n, h):
        return h[-(n - 2) :] if n > 2 else ()

    for n in range(2, order + 1):
        for (*h, w), r in tables[n - 1].items():
            of[n][tuple(h)] += r
            kept[n][tuple(h)] += less(ratios[n - 1], r)
            below[n][tuple(h)] += p(n - 1, shorter(n, tuple(h)), w)
        for h in of[n]:
            of[n][h] += kept[n][h] > of[n][h] * (1 - 1e-9)
    base = [sum(math.log10((words.get(w, 0) + 1) / (total + len(words) + 1)) for w in t) for t in tokens]
    score = [sum(math.log10(p(order, g[:-1], g[-1])) for g in grams(t, order)) for t in tokens]
    known = [sum(words.get(w, 0) > 0 for w in t) for t in tokens]
    return held, total, [len(t) for t in tokens], known, base, score, (words, p, of)


@pytest.mark.parametrize(("block", "order"), [(40, 2), (100_000, 2), (60, 3), (100_000, 1)])
def test_same_as_direct(make, monkeypatch, block, order):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    docs = rows()
    ours = {r.doc_id: r for r in katz.scored(make(*docs), katz.held_out(), order).collect()}
    held, total, n, known, base, score, _ = direct(docs, order)
    got = [ours[d] for d, _ in docs]
    assert [r.held_out for r in got] == held and {r.train_tokens for r in got} == {total} and [r.n_tokens for r in got] == n and [r.n_known for r in got] == known
    assert np.allclose([r.base_score for r in got], base, rtol=1e-12) and np.allclose([r.score for r in got], score, rtol=1e-10)


@pytest.mark.parametrize("order", [2, 3])
def test_distributions_sum_to_one(order):
    words, p, of = direct(rows(), order)[-1]
    contexts = [("<",), (b"w0",), (b"w50",), (b"never seen",)] if order == 2 else [("<",), ("<", b"w0"), (b"w1", b"w0"), (b"w50", b"never seen")]
    for h in contexts:
        assert abs(sum(p(order, h, w) for w in words) + p(order, h, b"not there") - 1) < 1e-9


def test_words_that_look_like_marks_are_words(make):
    docs = [(1, "a \0end b"), (3, "a b"), (4, "b"), (5, "\0start \0end")]
    ours = {r.doc_id: r for r in katz.scored(make(*docs), katz.held_out()).collect()}
    _, total, _, _, base, score, _ = direct(docs)
    assert np.allclose([ours[d].base_score for d, _ in docs], base) and np.allclose([ours[d].score for d, _ in docs], score) and ours[1].train_tokens == total


def test_odd_documents(odd, make):
    out = katz.scored(odd, katz.held_out()).collect()
    assert len(out) == 13 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in out)
    assert {r.n_tokens for r in out if r.doc_id == 1} == {1}
    assert katz.scored(make().where("false"), katz.held_out()).count() == 0


def test_nothing_to_learn_from(make):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = katz.scored(make((only, "a b")), katz.held_out()).first()
    assert row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0 and math.isfinite(row.score)
