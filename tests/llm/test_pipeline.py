import os

import pytest

from gutterline.llm import queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_stages_take_effect(spark, make, monkeypatch):
    if not os.path.isfile(queries.vocabulary("byte_bpe_50k.json")):
        pytest.skip("no vocabularies")
    prose = ["alpha beta gamma delta epsilon zeta eta theta " * 6 + f"number {'abcdefghij'[i % 10] * 3} {'klmnopqrst'[i // 10] * 4} end" for i in range(40)]
    docs = make(*enumerate(prose), (100, prose[3]), (101, "щжъы " * 80, None), (102, "99 !!"), (103, prose[5] + " Mail me: a.b@mail.example.com"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == docs.columns
        seen[name] = {r.doc_id for r in out.select("doc_id").collect()}
        docs = out
    assert seen["language_id"] == {*range(40), 100, 103}
    assert 100 not in seen["near_dedup"] and seen["pii"] == seen["near_dedup"] == seen["packing"]


def test_run_over_the_table(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
