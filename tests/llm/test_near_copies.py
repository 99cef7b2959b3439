import itertools
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gutterline.llm import common, near_copies

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def firsts(docs):
    """Ids that stay, by brute force over all pairs."""
    label = list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    sets = [grams(t) for _, t in docs]
    for i, j in itertools.combinations(range(len(docs)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            label[max(find(i), find(j))] = min(find(i), find(j))
    return sorted(docs[i][0] for i in range(len(docs)) if find(i) == i)


def edited(rng, text, n):
    words = text.split()
    for at in rng.integers(0, len(words), n).tolist():
        words[at] = f"edit{rng.integers(1 << 30)}"
    return " ".join(words)


@pytest.mark.parametrize("large", [2, 1024])
def test_stage_drops_edited_copies(spark, make, monkeypatch, large):
    monkeypatch.setattr(near_copies, "LARGE_BUCKET", large)
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice([f"w{i}" for i in range(500)], 200)) for _ in range(25)]
    texts = base + [edited(rng, t, n) for t in base for n in (1, 3, 4, 5, 6)] + [edited(rng, base[0], 3) for _ in range(40)]
    texts += [t + " " + " ".join(f"line{i}" for i in range(60)) for t in base] + [base[0].upper(), "", None, " \n", "one two", "One  two"]
    docs = list(enumerate(texts))
    kept = sorted(r.doc_id for r in corpus_pipeline.deduplicate(spark, make(*docs), "").select("doc_id").collect())
    assert kept == firsts(docs) and len(kept) < len(docs) - 100


def test_odd_documents(odd, make):
    kept = near_copies.first_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda v: (v is None, v)) == [1, 3, 4, 5, 6, 7, 9, 10, None]
    assert near_copies.first_of_each(make().where("false")).count() == 0


def test_order_knows_what_one_text_in_ten_thousand_has():
    assert near_copies.SAMPLE / 10_000 >= near_copies.COMMON_FROM


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    files = lambda: len(list(Path(spark.conf.get("spark.local.dir")).glob("**/shuffle_*.data")))
    before, rows = files(), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    for _ in range(5):
        assert common.stored(rows, "counts").count() == 7
    deadline = time.monotonic() + 20
    while files() > before + 5 and time.monotonic() < deadline:  # counting has a shuffle of its own
        time.sleep(0.2)
    assert files() <= before + 5 and spark.conf.get(common.CLEANUP) == "false"
