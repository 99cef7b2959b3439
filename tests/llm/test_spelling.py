import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gutterline.llm import spelling


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes one of the other."""
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def by_hand(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            n[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 199 == 0 else word] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    others = {w: [x for x in n if near(w, x)] for w in n}
    form = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in others.items() if xs}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n[w], len(others[w]), n.get(form.get(w), 0)) for w in n)


def found(docs):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(docs).collect())


@pytest.mark.parametrize("pieces", [2, 4, 8, 16])
def test_shards_report_each_pair_once(pieces):
    rnd = random.Random(pieces)
    for trial in range(40):
        words = sorted({"".join(rnd.choice("aé日\U0001f600"[: 1 + trial % 4]) for _ in range(rnd.randint(6, 9))) for _ in range(50)})
        rows = np.array([(k, m, m * p // pieces, m * (p + 1) // pieces) for k, w in enumerate(words) for m in {len(w), max(6, len(w) - 1)} for p in range(pieces)])
        a, b = spelling.shard_pairs(words, *rows.T)
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(i, j) for i in range(len(words)) for j in range(len(words)) if near(words[i], words[j])]


def test_suffix_ranks():
    rnd = random.Random(2)
    for _ in range(200):
        text = np.array([0, *(rnd.randint(1, 3) for _ in range(rnd.randint(0, 40))), 0])
        rotations = [tuple(np.roll(text, -k)) for k in range(len(text))]
        assert [rotations[k] for k in spelling.suffix_ranks(text)] == sorted(rotations)


@pytest.mark.parametrize("crowded", [3, 1 << 12])
def test_against_all_pairs(spark, make, monkeypatch, crowded):
    """Small shards, halves that many words share, and damage by the rule."""
    monkeypatch.setattr(spelling, "CROWDED", crowded)
    monkeypatch.setattr(spelling, "SHARD", 2000)
    rnd = random.Random(4)
    base = ["prefix" + "".join(rnd.choice("abä") for _ in range(4)) for _ in range(60)] + ["".join(rnd.choice("xyz") for _ in range(6)) + "ending" for _ in range(40)] + ["".join(rnd.choice("pq") for _ in range(rnd.randint(5, 8))) for _ in range(60)]
    docs = [(n, " ".join(rnd.choice(base[:: 1 + n % 9]).title() for _ in range(150))) for n in range(60)]
    docs += [(None, "Nullid nullid NULLID nullid nullid"), (61, None), (62, ""), (63, "x" * 40_000), (64, "École école ÉCOLE sixsix一sixsix sixsix sixsiy " * 9), (65, "sixsix " * 40), (65, "sixsix " * 40)]
    rows = found(make(*docs))
    assert rows == by_hand(docs) and sum(r[1] != "" for r in rows) > 5


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{n}", f"w{n + 1}") for n in range(20)], "word string, root string")
    assert {tuple(r) for r in spelling.rooted(forms).collect()} == {(f"w{n}", "w20") for n in range(20)}


def test_odd_documents(odd, make):
    assert [r[0] for r in found(odd)] == []
    assert spelling.variants(make().where("false")).count() == 0


def test_long_words(make):
    word = "ab" * 3000
    docs = [(n, f"{word} {word} {word[:-1]} {word[1:]} other words") for n in range(6)]
    assert found(make(*docs)) == by_hand(docs)
