import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gutterline.llm import common, tokenizing
from gutterline.llm import language_id as L


def words(seed, vowels, n=120):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(vowels), 2)) + rng.choice(["sta", "kri", "lon"]) for _ in range(n))


def corpus(make):
    return make(*[(i, words(i, "aeo"), "aa") for i in range(60)], *[(100 + i, words(i, "iuy"), "bb") for i in range(60)], (900, words(1, "aeo"), None), (901, None, "aa"), (902, "12 34!", "bb"), (903, "", "aa"), (904, "щжъы " * 80, None), (None, words(3, "iuy"), "bb"))


def test_languages_are_told_apart(make):
    rows = L.identify(corpus(make)).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 126
    assert all(by_id[i].lang_pred == "aa" and by_id[100 + i].lang_pred == "bb" for i in range(60))
    assert by_id[900].lang_pred == "aa" and by_id[None].lang_pred == "bb"
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 and by_id[i].rejected for i in (901, 902, 903))
    assert by_id[904].lang_pred in ("aa", "bb") and by_id[904].rejected
    assert all(0 <= r.score <= 1 for r in rows) and not by_id[3].rejected
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_held_out_labels_have_no_effect(make):
    docs = corpus(make)
    broken = docs.withColumn("lang", F.when(L.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, L.identify(d).collect()), key=str) for d in (docs, broken))
    assert a == b


def test_stage_keeps_what_it_accepts(make):
    docs = corpus(make)
    kept = L.without_rejected(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(60), *range(100, 160), 900, None}


def test_no_labels_and_no_rows(make, odd):
    assert {r.lang_pred for r in L.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert L.identify(make().where("false")).count() == 0


def test_probabilities_sum_to_one():
    codes, _ = L.symbols([words(5, "aeo")])
    model = L.Model.fit(codes, alphabet := len(np.unique(codes)))
    symbols = np.unique(codes)
    assert alphabet == len(symbols)
    for context in ([], [symbols[3]], [symbols[2], symbols[4]], [symbols[1], symbols[2], symbols[3]]):
        key = np.uint64(0)
        for c in context:
            key = (key << np.uint64(16)) | c
        total = model.lookup((key << np.uint64(16)) | symbols, len(context) + 1).sum()
        assert abs(total - 1) < 1e-9


def test_odd_documents(odd):
    assert L.identify(odd).count() == 13


@pytest.mark.parametrize(("counts", "total", "share"), [([1000] * 4, 1600, 400), ([1] * 96 + [1000] * 4, 1600, 376), ([5, 5], 100, 95), ([], 10, 10)])
def test_shares_of_the_sample(counts, total, share):
    assert L.even_share(counts, total) == share and sum(min(c, share) for c in counts) <= total


def test_a_worker_keeps_one_model_or_encoder(monkeypatch):
    monkeypatch.setattr(common, "_RESIDENT", {})
    first = common.resident("model", lambda: [1])
    assert common.resident("model", lambda: [2]) is first
    kept = tokenizing._resident(lambda path, dtype: [path, dtype])
    encoder = kept("vocabulary", "<u4")
    assert kept("vocabulary", "<u4") is encoder and list(common._RESIDENT.values()) == [encoder]
    assert common.resident("model", lambda: [3]) == [3] and kept("vocabulary", "<u4") is not encoder


def test_places_are_looked_up_in_parts(monkeypatch):
    texts = [words(1, "aeo"), "", words(2, "iuy"), "x", words(3, "aeo", 700)]
    identifier = L.Identifier({lang: L.Model.fit(L.symbols([words(s, v, 400)])[0], 64).dump() for lang, s, v in (("aa", 8, "aeo"), ("bb", 9, "iuy"))})
    codes, of = L.symbols(texts)
    log_p = identifier.log_probability([p[1:] for p in L.grams(codes)])
    direct = -np.stack([np.bincount(of[1:], log_p[:, k], len(texts)) for k in range(2)], axis=1)
    seen = []
    look = identifier.log_probability
    monkeypatch.setattr(L, "LOOKED_UP", 50)
    monkeypatch.setattr(identifier, "log_probability", lambda parts, n=L.ORDER: seen.append(len(parts[0])) or look(parts, n))
    entropy, n = identifier.entropies(texts)
    assert max(seen) <= 50 and n[1] == 0
    assert all((entropy[i] == direct[i] / n[i]).all() for i in (0, 2, 3, 4))
    assert identifier.entropies([])[0].shape == (0, 2) and np.isinf(identifier.entropies(["", "1"])[0]).all()
