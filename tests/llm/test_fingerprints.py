import hashlib

import numpy as np

from gutterline.llm import fingerprints as Q


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def resemblance(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_edits_and_likeness(make):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"], rng.integers(20, 400))) for _ in range(80)]
    rows = sorted(Q.edited_fingerprints(make(*enumerate(texts))).collect(), key=lambda r: r.doc_id)
    edited = [t[: len(t) - len(t) // 2] + texts[(i + 1) % 80][: len(t) // 2] for i, t in enumerate(texts)]
    assert [r.edited_sha256 for r in rows] == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    assert [r.n_chars for r in rows] == [len(t) for t in texts]
    off = [r.near_edited - resemblance(t, e) for r, t, e in zip(rows, texts, edited, strict=True)]
    assert np.abs(off).mean() < 0.035 and abs(np.mean(off)) < 0.015
    off = [r.near_next - resemblance(t, texts[(i + 1) % 80]) for i, (r, t) in enumerate(zip(rows, texts, strict=True))]
    assert np.abs(off).mean() < 0.035


def test_many_ranges_have_the_same_successors(make, monkeypatch):
    texts = [f"text number {i} with some words in it" for i in range(50)]
    one = sorted(map(tuple, Q.edited_fingerprints(make(*enumerate(texts))).collect()))
    monkeypatch.setattr(Q, "MAX_RANGES", 3)
    assert one == sorted(map(tuple, Q.edited_fingerprints(make(*enumerate(texts))).collect()))


def test_odd_documents(odd, make):
    rows = Q.edited_fingerprints(odd).collect()
    assert len(rows) == 13 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 2 * Q.BINS for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by_text[7] == by_text[8] and by_text[1] == by_text[2] and len(by_text[9]) == 1
    assert Q.edited_fingerprints(make().where("false")).count() == 0


def test_a_single_document_follows_itself(make):
    row = Q.edited_fingerprints(make((5, "abcdef"))).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1.0


def test_main_path_is_native(make):
    plan = Q.edited_fingerprints(make((1, "a b"), (2, "c d")))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
