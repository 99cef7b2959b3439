import itertools
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gutterline.llm import simhash


def slow_fingerprint(text):
    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(ids, prints):
    """Smallest id reachable over pairs within the radius."""
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            label[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_masks_cover_every_pair():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks()]
    rng = np.random.default_rng(1)
    assert len(masks) == 31
    for _ in range(3000):
        places = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(m & places == 0 for m in masks)


def test_fingerprints_and_components(make):
    rng = np.random.default_rng(2)
    base = [" ".join(rng.choice([f"w{i}" for i in range(500)], 120)) for _ in range(30)]
    docs = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " tail") for i, t in enumerate(base)] + [(200, ""), (201, None), (202, "One Two"), (203, "one two"), (204, base[0])]
    rows = {r.doc_id: r for r in simhash.near_duplicates(make(*docs)).collect()}
    prints = [slow_fingerprint(t) for _, t in docs]
    assert [rows[d].fingerprint for d, _ in docs] == [format(p, "016x") for p in prints]
    assert [rows[d].component_id for d, _ in docs] == brute([d for d, _ in docs], prints)


@pytest.mark.parametrize("large", [2, 1024])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE_BUCKET", large)
    rng = np.random.default_rng(3)
    prints = set()
    for centre in rng.integers(0, 1 << 62, 6).tolist():
        for _ in range(40):
            value = centre
            for b in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                value ^= 1 << b
            prints.add(value - (1 << 64) if value >> 63 else value)
    prints = sorted(prints)
    docs = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fp long")
    rows = docs.join(simhash.classes(docs), "fp").orderBy("doc_id").collect()
    assert [r.component_id for r in rows] == brute(list(range(len(prints))), [p & (1 << 64) - 1 for p in prints])


def test_odd_documents(odd, make):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 13 and {r.component_id for r in rows if r.doc_id in (1, 2)} == {1} and {r.component_id for r in rows if r.doc_id in (7, 8)} == {7}
    assert simhash.near_duplicates(make().where("false")).count() == 0


def test_one_of_each_stays(odd, make):
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda v: (v is None, v)) == [1, 3, 4, 5, 6, 7, 9, 10, None]
    assert simhash.first_of_each(make().where("false")).count() == 0


def test_long_chains_are_one_component(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in simhash.components(edges).collect()} == {0}
